"""Alignment of two tokenizers' ids by a dictionary of token groups.

A text, with a space before it, is encoded by a byte-level BPE (A) and, as it is, by a piece model (B) that adds that space. Strings of special tokens inside a text are plain text. Where both encodings' bytes are those of the spaced
text, the byte offsets at which tokens of both end cut it into groups: the fewest tokens of A and of B that cover the same bytes. Tokens whose bytes overlap are linked, which they only are within a group; a group of p
and q tokens has p + q - 1 links, as no inner ends meet.

Group dictionary. A group is known by its A ids and B ids, which fix its links; it is interned under two 64-bit hashes of them. A task keeps a dictionary of the groups that it met: links are expanded once for each of
them, and documents name groups by number. From a document's distinct groups come its distinct id pairs, so a pair that several groups of a document share counts once; counts are added up by pair in the task
(at most ``HELD`` groups at a time) and then by a grouped sum. All tasks' groups then make one dictionary with the number of documents of each. Its links are expanded once more, meet the pairs' counts, and give each group two
numbers: the sum of its links' counts and how many of them are best for their A id. Documents get theirs by joining their distinct groups, with how often they come, to the dictionary.

Frequent keys. Both joins (links to pairs, documents' groups to the dictionary) look up the ``HEAD`` most frequent keys in a broadcast table of that many rows at most and shuffle only what isn't there, so no key with a large share
of the rows is in a shuffle. Nothing is dropped: a pair or group is in one of both tables.

Nulls: texts that are null or empty, or whose A or B bytes differ, have no tokens: zeros, and '' for the hash. A null doc_id is kept as null. Repeated rows stay repeated, and each is a document of its own. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .brown import above, slices
from .common import cut, release, ship
from .packing import BYTE_OF, Encoder
from .words import LONGEST, WordIds, spread

HEAD, HELD = 1 << 16, 1 << 17
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_ROW = "kind int, row long, doc_id long, n_a long, n_b long, n_groups long, sha string, h long, l long, a array<int>, b array<int>, pair long, n long, keys binary, times binary"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_TYPES = [pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


class Pieces:
    """ids of the piece model: no piece goes on past a word into spaces, so words are encoded apart, with the space before them, and looked up once."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.apart = not any(" " in b.lstrip(b" ").decode("utf-8", "replace") for i, b in enumerate(self.bytes) if not self.model.is_byte(i))
        self.space = self.model.piece_to_id("▁")
        probe = " two  spaces,\nthree   more été 東京 "
        self.words = WordIds(self.learn)
        if self.apart and self.encode([b" " + probe.encode()])[0].tolist() != self.model.encode(probe):
            self.apart = False

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each word begins with a space, which the model adds, but not to nothing."""
        ids = [x or [self.space] for x in self.model.encode([w[1:].decode() for w in words], num_threads=1)]
        cnt = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(cnt.sum())), cnt

    def encode(self, spaced: list[bytes]) -> list[np.ndarray]:
        """ids of texts, each given with the space before it."""
        if not self.apart:
            return [np.array(x, np.uint32) for x in self.model.encode([t[1:].decode() for t in spaced], num_threads=1)]
        data = b"".join(spaced)
        if not data:
            return [np.zeros(0, np.uint32)] * len(spaced)
        buf = np.frombuffer(data, np.uint8)
        docs = np.concatenate(([0], np.cumsum(np.fromiter(map(len, spaced), np.int64, len(spaced)))))
        starts = np.zeros(len(buf), bool)
        starts[1:] = (buf[1:] == 32) & (buf[:-1] != 32)
        starts[docs[:-1][np.diff(docs) > 0]] = True
        starts = np.flatnonzero(starts)
        ids, cnt = self.words.ids(data, starts, np.diff(starts, append=len(buf)))
        upto = np.concatenate(([0], np.cumsum(cnt)))
        cuts = upto[np.searchsorted(starts, docs)]
        return [ids[s:e] for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class Pair:
    """Both tokenizers with their tokens' bytes."""

    def __init__(self, a: str | None = None, b: str | None = None):
        self.a, self.b = Encoder(a), Pieces(b)
        self.a.model.encode_special_tokens = True
        names = (self.a.model.id_to_token(i) or "" for i in range(self.a.model.get_vocab_size()))
        self.bytes = [bytes(BYTE_OF[c] for c in t) if all(c in BYTE_OF for c in t) else t.encode() for t in names]
        self.sizes = tuple(np.fromiter(map(len, t), np.int64, len(t)) for t in (self.bytes, self.b.bytes))

    def encode(self, spaced: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """ids of both; none where the bytes of either aren't the text's."""
        none = np.zeros(0, np.uint32)
        a, b = self.a.encode(spaced), self.b.encode(spaced)
        right = [b"".join(map(self.bytes.__getitem__, x.tolist())) == t == b"".join(map(self.b.bytes.__getitem__, y.tolist())) for t, x, y in zip(spaced, a, b, strict=True)]
        return [x if ok else none for x, ok in zip(a, right, strict=True)], [y if ok else none for y, ok in zip(b, right, strict=True)]


_PAIRS: dict = {}


def pair_of(a: str | None, b: str | None) -> Pair:
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = Pair(a, b)
    return _PAIRS[a, b]


def hashes(first: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each run of ids that begins at first."""
    place = np.arange(len(ids)) - np.repeat(first, np.diff(first, append=len(ids)))
    return [np.add.reduceat(spread((ids.astype(np.uint64) + np.uint64(1)) * s + spread(place.astype(np.uint64) + s)), first) for s in _SEEDS]


def links_of(a: list[int], b: list[int], sizes) -> list[tuple[int, int]]:
    """Linked (A id, B id) of one group, as often as they are: neighbours in a merge of both rows of ends."""
    ea, eb = list(accumulate(int(sizes[0][i]) for i in a)), list(accumulate(int(sizes[1][i]) for i in b))
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        out.append((a[i], b[j]))
        if ea[i] < eb[j]:
            i += 1
        elif ea[i] > eb[j]:
            j += 1
        else:
            i, j = i + 1, j + 1
    return out


class Groups:
    """A task's dictionary of groups: their ids, texts and pairs, documents with each, and documents with each pair."""

    def __init__(self, pair: Pair):
        self.pair, self.at, self.ids, self.text, self.pairs = pair, {}, [], [], []
        self.pair_at: dict[int, int] = {}
        self.docs, self.pair_docs = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def intern(self, h: list[int], l: list[int], content) -> list[int]:
        out = []
        for k, key in enumerate(zip(h, l, strict=True)):
            n = self.at.get(key)
            if n is None:
                n = self.at[key] = len(self.ids)
                a, b = content(k)
                self.ids.append((a, b))
                self.text.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
                self.pairs.append(sorted({self.pair_at.setdefault(x << 32 | y, len(self.pair_at)) for x, y in links_of(a, b, self.pair.sizes)}))
            out.append(n)
        return out

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), np.int64)])

    def seen(self, doc: np.ndarray, group: np.ndarray) -> None:
        """Distinct (document, group) of whole documents: counts documents of groups and of pairs."""
        self.docs, self.pair_docs = self._room(self.docs, len(self.ids)), self._room(self.pair_docs, len(self.pair_at))
        self.docs += np.bincount(group, minlength=len(self.docs))
        used, back = np.unique(group, return_inverse=True)
        lists = [self.pairs[g] for g in used.tolist()]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat, first = np.fromiter((p for x in lists for p in x), np.int64, int(size.sum())), np.cumsum(size) - size
        n = size[back]
        at = np.repeat(first[back] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.unique(np.repeat(doc, n) * len(self.pair_at) + flat[at])
        self.pair_docs += np.bincount(both % len(self.pair_at), minlength=len(self.pair_docs))

    def rows(self):
        """Record batches of the dictionary (kind 1) and of the pairs' counts (kind 2)."""
        keys = list(self.at)
        for s in range(0, len(keys), 4096):
            part = self.ids[s : s + 4096]
            h, l = (np.array([k[i] for k in keys[s : s + 4096]], np.uint64).view(np.int64) for i in (0, 1))
            yield batch(len(part), kind=np.full(len(part), 1), h=h, l=l, a=[x for x, _ in part], b=[y for _, y in part], n=self.docs[s : s + len(part)])
        pairs = np.fromiter(self.pair_at, np.int64, len(self.pair_at))
        for s in range(0, len(pairs), 1 << 15):
            part = pairs[s : s + (1 << 15)]
            yield batch(len(part), kind=np.full(len(part), 2), pair=part, n=self.pair_docs[s : s + len(part)])


def batch(rows: int, /, **of) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(of[k], t) if k in of else pa.nulls(rows, t) for k, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


def grouped(pair: Pair, texts: list[bytes]):
    """(A ids, B ids, where each group begins in either, tokens of each document in either, groups of each document) of a block of texts."""
    a, b = pair.encode([b" " + t if t else b"" for t in texts])
    na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    a, b = np.concatenate(a), np.concatenate(b)
    ea, eb = np.cumsum(pair.sizes[0][a]), np.cumsum(pair.sizes[1][b])  # over documents with tokens, in which both have the same bytes
    met = np.zeros((2, int(ea[-1]) + 1 if len(ea) else 1), bool)
    met[0, ea], met[1, eb] = True, True
    fa, fb = (np.append(0, np.flatnonzero(other[e])[:-1] + 1) if len(e) else np.zeros(0, np.int64) for e, other in ((ea, met[1]), (eb, met[0])))
    upto = np.searchsorted(fa, np.cumsum(na))
    return a, b, fa, fb, na, nb, np.diff(upto, prepend=0)


def encoded(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """One row for each document (kind 0: counts, its distinct groups' hashes and how often each comes), the tasks' groups (kind 1) and their pairs' documents (kind 2)."""

    def each(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 33
        pair = pair_of(a, b)
        groups = Groups(pair)
        for part, texts in slices(batches, 1):
            ids_a, ids_b, fa, fb, na, nb, ng = grouped(pair, texts)
            doc = np.repeat(np.arange(len(texts)), ng)
            keys = [x + spread(y) for x, y in zip(hashes(fa, ids_a), hashes(fb, ids_b), strict=True)] if len(fa) else [np.zeros(0, np.uint64)] * 2
            one, first, back = np.unique(keys[0], return_index=True, return_inverse=True)
            clash = np.flatnonzero(keys[1] != keys[1][first][back]) if len(fa) else first
            if len(clash):  # equal in one hash only
                both = np.unique(np.stack(keys, axis=1), axis=0, return_index=True, return_inverse=True)
                first, back = both[1], both[2].ravel()
            la, lb = np.append(fa, len(ids_a)), np.append(fb, len(ids_b))
            content = lambda k: (ids_a[la[first[k]] : la[first[k] + 1]].tolist(), ids_b[lb[first[k]] : lb[first[k] + 1]].tolist())  # noqa: B023, E731
            number = np.array(groups.intern(keys[0][first].tolist(), keys[1][first].tolist(), content), np.int64)
            mine = number[back]
            upto = np.concatenate(([0], np.cumsum(ng)))
            if len(mine):
                order = np.argsort(doc * len(groups.ids) + mine, kind="stable")
                new = np.append(True, (mine[order][1:] != mine[order][:-1]) | (doc[order][1:] != doc[order][:-1]))
                begin = np.flatnonzero(new)
                at, times = order[begin], np.diff(begin, append=len(order))
                groups.seen(doc[at], mine[at])
            else:
                at = times = np.zeros(0, np.int64)
            data = np.stack([keys[0][at], keys[1][at]], axis=1).tobytes()
            many = times.astype("<i4").tobytes()
            place = np.concatenate(([0], np.cumsum(np.bincount(doc[at], minlength=len(texts))))).tolist()
            names, text = mine.tolist(), groups.text
            sha = [hashlib.sha256(";".join([text[g] for g in names[s:e]]).encode()).hexdigest() if e > s else "" for s, e in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
            n = len(texts)
            yield batch(n, kind=np.zeros(n), row=row + np.arange(n), doc_id=part.column(0), n_a=na, n_b=nb, n_groups=ng, sha=sha, keys=[data[16 * s : 16 * e] for s, e in zip(place, place[1:], strict=False)], times=[many[4 * s : 4 * e] for s, e in zip(place, place[1:], strict=False)])
            row += n
            if len(groups.ids) > HELD:
                yield from groups.rows()
                groups = Groups(pair)
        yield from groups.rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text")).mapInArrow(each, _ROW)


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], often: str, values: list[Column]) -> DataFrame:
    """rows, all of whose keys are in table, with table's values; keys of table are distinct. The HEAD keys that come most often are broadcast, the others' rows are shuffled."""
    at = above(table.select(F.col(often).alias("c")), HEAD)
    head, rest = table.where(F.col(often) >= at).select(*keys, *values, F.lit(True).alias("_head")), table.where(F.col(often) < at).select(*keys, *values)
    met = rows.join(F.broadcast(head), keys, "left")
    names = [c for c in met.columns if c != "_head"]
    return met.where("_head").select(*names).unionByName(met.where("_head is null").select(*rows.columns).join(rest, keys).select(*names))


def dictionary(found: DataFrame, sizes) -> tuple[DataFrame, DataFrame]:
    """(groups (h, l, docs, n_best, count_sum), pairs (a, b, n, best)) of encoded rows; best: the pair has its A id's highest count."""
    pairs = found.where("kind = 2").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = cut(pairs.select("pair", (F.shiftright("pair", 32)).cast("int").alias("a"), "n"))
    top = pairs.groupBy("a").agg(F.max("n").alias("_top"))  # a row for each A id, so as many as the vocabulary has
    groups = cut(found.where("kind = 1").groupBy("h", "l").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.sum("n").alias("docs")))

    def expand(batches):
        for b in batches:
            out = [links_of(x, y, sizes) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            n = np.fromiter(map(len, out), np.int64, len(out))
            at = pa.array(np.repeat(np.arange(len(out)), n))
            pair = np.fromiter((x << 32 | y for z in out for x, y in z), np.int64, int(n.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(4).take(at), pa.array(pair)], ["h", "l", "docs", "pair"])

    links = cut(groups.mapInArrow(expand, "h long, l long, docs long, pair long").groupBy("h", "l", "docs", "pair").agg(F.count(F.lit(1)).alias("times")))
    often = links.groupBy("pair").agg(F.count(F.lit(1)).alias("groups"))
    pairs_ = cut(pairs.join(often, "pair").join(top, "a").select("pair", "a", F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("b"), "n", (F.col("n") == F.col("_top")).alias("best"), "groups"))
    met = looked_up(links, pairs_, ["pair"], "groups", [F.col("n"), F.col("best")])
    told = met.groupBy("h", "l").agg(F.first("docs").alias("docs"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    told = cut(told)
    release(pairs, groups, links)
    return told, pairs_


def align(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    found = cut(encoded(docs, a, b))
    groups, pairs = dictionary(found, pair_of(a, b).sizes)
    release(pairs)

    def each(batches):
        for x in batches:
            for s in range(0, x.num_rows, 64):
                part = x.slice(s, 64)
                keys, times = (np.frombuffer(b"".join(part.column(k).to_pylist()), t) for k, t in ((1, "<i8"), (2, "<i4")))
                n = np.fromiter((len(v) // 4 for v in part.column(2).to_pylist()), np.int64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), n))), pa.array(keys[0::2]), pa.array(keys[1::2]), pa.array(times.astype(np.int64))], ["row", "h", "l", "times"])

    own = found.where("kind = 0")
    uses = own.select("row", "keys", "times").mapInArrow(each, "row long, h long, l long, times long")
    met = looked_up(uses, groups, ["h", "l"], "docs", [F.col("n_best"), F.col("count_sum")])
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.col("n_best")).alias("n_best"), F.sum(F.col("times") * F.col("count_sum")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return own.select("row", "doc_id", "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"), F.col("sha").alias("groups_sha256")).join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )


def pair_counts(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(a, b, n, best): how many documents link each pair of ids, and whether that is its A id's highest count."""
    ship(docs.sparkSession)
    return dictionary(cut(encoded(docs, a, b)), pair_of(a, b).sizes)[1].select("a", "b", "n", "best")
