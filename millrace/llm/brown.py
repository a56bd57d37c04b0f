"""Class-based bigrams over Brown clusters, by the exchange algorithm.

Tokens are A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+`` and one end for each text. Training rows are those whose crc32(doc_id) mod 10 isn't 0; a word's count
covers all of them. The end has a class of its own, words have ``CLASSES - 1``.

Clustering. The core are all words that make up one in ``CORE`` or more of the training tokens, so at most ``CORE`` words, whatever the input. The ``SEEDS`` most frequent are clustered first, by
exchange over their own bigrams: words move one at a time to the class where the classes' bigrams are likeliest, until none moves. Then the whole core is exchanged: a pass over the
training rows, kept as core words' numbers of two bytes, counts, for each core word, the classes before and after it; with these counts words move one at a time as before. Passes are repeated until less than ``STILL``
of the core's tokens move, or until a pass no longer makes the class bigrams likelier (within a pass, counts are those of the pass before, so it may not); the likeliest classes stand. Rarer words then go, each by itself, to the class that its own neighbours make likeliest, in one more pass. Neighbours outside the core say nothing there;
a word without other neighbours goes to the class of most core words. Class bigrams are counted anew with all words placed. A word that training rows lack is given the class of most distinct words.

With c the word's count, P(word | class) = (c + A) / (n(class) + A * (v(class) + 1)), P(class | last) = (n(last, class) + B * n(class) / N) / (n(last) + B), and a token's probability is
``SHARE`` times their product and the rest of the smoothed unigram. As both smooth counts by A = 0.1, a token's log is log10(c + 0.1) plus a term of the classes
alone; only the first needs a count.

Counts and classes of the core and of at most ``HEAD`` next words (those above a count that a histogram of counts gives) are broadcast, a fixed bound; the other words' tokens meet theirs in a join on the words' 128-bit
hashes and go back to their places in the texts, so no table that grows with the vocabulary is held in one place. At most CORE * (2 * CLASSES + 2) sums reach the driver in a pass.

Nulls: a null text is empty (one token, the end). A null doc_id counts as training and stays null. Repeated rows stay repeated and count in training as often; equal texts of different doc_ids are rows of their own. An empty
table gives an empty result; where no word makes up one in ``CORE`` of the training tokens (no words at all, or none that repeats enough), there is no core, and all words share a class. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, LOWER, cut, release, ship, text_name
from .words import LONGEST, Table, spread, word_hashes

FOLDS, CORE, SEEDS, CLASSES, STILL, HEAD, SHARE, A, B = 10, 60_000, 768, 48, 0.01, 1 << 18, 0.95, 0.1, 5.0
OWN, REST = 2 * CLASSES, 2 * CLASSES + 1  # slots of a word's neighbours: classes before, classes after, itself before, a word outside the core before
SLICE, HELD = 1 << 21, 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def tokens(texts: list[bytes]):
    """(document number, hash, other hash) of every word of the texts, in order."""
    data = b"".join(texts).translate(LOWER)
    docs = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    buf = np.frombuffer(data, np.uint8)
    ink = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[docs] = True
    starts = np.flatnonzero(ink & ~(np.append(False, ink[:-1]) & ~edge[:-1]))
    ends = np.flatnonzero(ink & ~(np.append(ink[1:], False) & ~edge[1:])) + 1
    lens = ends - starts
    one, two = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    short = lens <= LONGEST
    if short.any():
        one[short], two[short] = word_hashes(buf, starts[short], lens[short])
    for k in np.flatnonzero(~short):
        word = data[starts[k] : ends[k]]
        one[k], two[k] = xxhash.xxh64_intdigest(word, 1) or 1, xxhash.xxh64_intdigest(word, 2)
    return np.searchsorted(docs, starts, side="right") - 1, one, two


def slices(batches, column: int):
    """(batch, texts) of about SLICE bytes of text."""
    for b in batches:
        texts, s = b.column(column).to_pylist(), 0
        while s < b.num_rows:
            e, size = s, 0
            while e < b.num_rows and (e == s or size + len(texts[e] or b"") <= SLICE):
                size += len(texts[e] or b"")
                e += 1
            yield b.slice(s, e - s), [t or b"" for t in texts[s:e]]
            s = e


def total(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums of n for rows of equal keys: one for each distinct row, but for chance a few more."""
    mixed = keys[0].astype(np.uint64)
    for k in keys[1:]:
        mixed = spread(mixed) + k.astype(np.uint64)
    order = np.argsort(mixed)
    keys, n = [k[order] for k in keys], n[order]
    if not len(n):
        return keys, n
    new = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
    return [k[new] for k in keys], np.add.reduceat(n, np.flatnonzero(new))


def source(docs: DataFrame) -> DataFrame:
    """Rows with a name (id, tie) that repeated rows share, whether held out, and UTF-8 text."""
    text, doc_id = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    held = F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))
    id_, tie = text_name(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text))
    return docs.select(doc_id.alias("doc_id"), id_.alias("id"), tie.alias("tie"), held.alias("held_out"), F.encode(text, "UTF-8").alias("data"))


def summed(batches, of, names: list[str]):
    """Record batches of the sums of of(texts) -> (keys, n) by keys, kept in memory up to about HELD of them."""
    held, size = [], 0

    def merged():
        return total([np.concatenate(x) for x in zip(*[k for k, _ in held], strict=True)], np.concatenate([n for _, n in held]))

    def out():
        keys, n = merged()
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64) if k.dtype == np.uint64 else k.astype(np.int32)) for k in keys] + [pa.array(n)], [*names, "n"])

    for _, texts in slices(batches, 0):
        held.append(total(*of(texts)))
        size += len(held[-1][1])
        if size > 2 * HELD:
            held = [merged()]
            size = len(held[0][1])
            if size > HELD:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def vocabulary(rows: DataFrame) -> DataFrame:
    """(h, l, c): the count of each word of the training rows."""

    def words(texts):
        _, one, two = tokens(texts)
        return [one, two], np.ones(len(one), np.int64)

    each = lambda batches: summed(batches, words, ["h", "l"])
    found = rows.where("not held_out").select("data").mapInArrow(each, "h long, l long, n long")
    return cut(found.groupBy("h", "l").agg(F.sum("n").alias("c")))


class Types:
    """Types of tokens: core words, then all others, then the end."""

    def __init__(self, h: np.ndarray, l: np.ndarray):
        self.core, self.table = len(h), Table(max(16, 1 << int(len(h)).bit_length()))
        self.table.add(h, l, np.arange(len(h)))
        self.rest, self.end = self.core, self.core + 1

    def of(self, one, two) -> np.ndarray:
        found = self.table.find(one, two)
        return np.where(found < 0, self.rest, found)

    def runs(self, doc, types, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(last type, type) of each token of n documents in turn, ends included; the end stands before the first."""
        run = np.full(len(doc) + n, self.end)
        run[np.arange(len(doc)) + doc] = types
        return np.append(self.end, run[:-1]), run


def numbered(rows: DataFrame, types: Types) -> DataFrame:
    """(seq) for each training row: the types of its tokens, two bytes each, the end last."""

    def each(batches):
        for b, texts in slices(batches, 0):
            doc, one, two = tokens(texts)
            _, run = types.runs(doc, types.of(one, two), len(texts))
            upto = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts)) + 1))).tolist()
            data = run.astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([data[2 * s : 2 * e] for s, e in zip(upto, upto[1:], strict=False)], pa.binary())], ["seq"])

    return cut(rows.where("not held_out").select("data").mapInArrow(each, "seq binary"))


def counted(seqs: DataFrame, of, cells: int) -> np.ndarray:
    """How often each cell is met, of(last types, types) -> cells, over the tokens of numbered rows; cells is bounded."""

    def each(batches):
        seen = np.zeros(cells, np.int64)
        for b in batches:
            if b.num_rows:
                run = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u2").astype(np.int64)
                at = of(run)
                for s in range(0, len(at), 1 << 20):
                    part = at[s : s + (1 << 20)]
                    if cells < 1 << 18:
                        seen += np.bincount(part, minlength=cells)
                    else:
                        np.add.at(seen, part, 1)
        cell = np.flatnonzero(seen)
        for s in range(0, len(cell), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(cell[s : s + (1 << 16)]), pa.array(seen[cell[s : s + (1 << 16)]])], ["cell", "n"])

    got = seqs.mapInArrow(each, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def bigrams(seqs: DataFrame, types: Types, seeds: int) -> np.ndarray:
    """Counts of (last, next) over the training rows, of the first seeds words of the core and, as the last number, the end."""
    m = seeds + 1

    def of(run):
        run = np.where(run == types.end, seeds, np.where(run < seeds, run, m))
        last = np.append(seeds, run[:-1])
        both = (last < m) & (run < m)
        return last[both] * m + run[both]

    return counted(seqs, of, m * m).reshape(m, m)


def exchange(n: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each type, from bigram counts n; the last type keeps class 0 for itself."""
    m = len(n)
    weight = n.sum(axis=1) + n.sum(axis=0)
    at = np.zeros(m, np.int64)
    order = np.argsort(-weight[:-1], kind="stable")
    at[order] = 1 + np.arange(m - 1) % (classes - 1)
    one = np.eye(classes)[at]
    pair = one.T @ n @ one
    left, right = n @ one, n.T @ one  # of each type: to the classes after it, from those before it
    f = lambda x: x * np.log(np.maximum(x, 1))
    moved, least = 1, 1e-9 + 1e-12 * f(n.sum())  # well above what rounding can add, so each move is a gain and the rounds end
    while moved:
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            a, own = at[w], n[w, w]
            out, into = left[w].copy(), right[w].copy()  # towards and from each class, w itself aside
            out[a] -= own
            into[a] -= own
            pair[a] -= out
            pair[:, a] -= into
            pair[a, a] -= own
            row, col = pair.sum(axis=1) + into, pair.sum(axis=0) + out  # what leads to w or from it counts wherever w goes
            # gain of joining each class: its row, its column and the cell in both
            fp = f(pair)
            gain = (f(pair + out) - fp).sum(axis=1) + (f(pair.T + into) - fp.T).sum(axis=1)
            d = np.diag(pair)
            gain += f(d + out + into + own) - f(d + out) - f(d + into) + f(d)
            gain -= f(row + out.sum() + own) - f(row) + f(col + into.sum() + own) - f(col)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + least:
                b = a
            pair[b] += out
            pair[:, b] += into
            pair[b, b] += own
            if b != a:
                at[w], moved = b, moved + 1
                left[:, a] -= n[:, w]
                left[:, b] += n[:, w]
                right[:, a] -= n[w]
                right[:, b] += n[w]
    return at


def neighbours(types: Types, at: np.ndarray, texts: list[bytes]):
    """(one, two, type, slot) of the neighbours of all words of texts; at: the class of each type, -1 where it has none."""
    doc, one, two = tokens(texts)
    kind = types.of(one, two)
    last, run = types.runs(doc, kind, len(texts))
    place = np.arange(len(doc)) + doc
    same = np.append(False, (one[1:] == one[:-1]) & (two[1:] == two[:-1]) & (doc[1:] == doc[:-1]))[: len(doc)]
    left, right = at[last[place]], at[run[place + 1]]
    before = np.where(same, OWN, np.where(left < 0, REST, left))
    ahead = ~np.append(same[1:], False)[: len(doc)] & (right >= 0)
    return tuple(np.concatenate([x, x[ahead]]) for x in (one, two, kind)) + (np.concatenate([before, CLASSES + right[ahead]]),)


def core_contexts(seqs: DataFrame, types: Types, at: np.ndarray) -> np.ndarray:
    """Counts by core word and slot over the training rows; at: the class of each type, -1 where it has none."""

    def of(run):
        last, after = np.append(types.end, run[:-1]), np.append(run[1:], types.end)
        word = run < types.core
        before = np.where(last == run, OWN, np.where(at[last] < 0, REST, at[last]))
        ahead = word & (after != run) & (at[after] >= 0)
        return np.concatenate([run[word] * (REST + 1) + before[word], run[ahead] * (REST + 1) + CLASSES + at[after[ahead]]])

    return counted(seqs, of, types.core * (REST + 1)).reshape(types.core, REST + 1)


def core_bigrams(seen: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Class bigrams among core words and the end, from their neighbours' classes seen under the classes at; -1: none yet."""
    left, own = seen[:, CLASSES:OWN], seen[:, OWN]
    one = np.eye(CLASSES)[np.maximum(at, 0)] * (at >= 0)[:, None]
    pair = one.T @ left
    pair[0] = one.T @ seen[:, 0]  # what begins a text
    np.add.at(pair, (np.maximum(at, 0), np.maximum(at, 0)), np.where(at >= 0, own, 0))
    return pair


def likelihood(pair: np.ndarray) -> float:
    """What class bigrams add to the log likelihood."""
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(pair) - f(pair.sum(axis=1)) - f(pair.sum(axis=0))


def core_exchange(seen: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(classes, class bigrams, share of tokens moved) after each core word, by its neighbours' classes seen, has moved to its best class; -1: none yet."""
    at = at.copy()
    right, left, own, weight = seen[:, :CLASSES], seen[:, CLASSES:OWN], seen[:, OWN], seen.sum(axis=1) + seen[:, OWN]
    old, count = at.copy(), seen[:, [*range(CLASSES), OWN, REST]].sum(axis=1)
    pair = core_bigrams(seen, at)
    f = lambda x: x * np.log(np.maximum(x, 1))
    for w in np.argsort(-weight, kind="stable"):
        a, out, into, n = at[w], left[w], right[w], own[w]
        if a >= 0:
            pair[a] -= out
            pair[:, a] -= into
            pair[a, a] -= n
            np.maximum(pair, 0, out=pair)
        row, col, d = pair.sum(axis=1) + into, pair.sum(axis=0) + out, np.diag(pair)
        cell = f(pair)
        gain = (f(pair + out) - cell).sum(axis=1) + (f(pair.T + into) - cell.T).sum(axis=1)
        gain += f(d + out + into + n) - f(d + out) - f(d + into) + f(d)
        gain -= f(row + out.sum() + n) - f(row) + f(col + into.sum() + n) - f(col)
        gain[0] = -np.inf
        b = int(gain.argmax())
        if a >= 0 and gain[b] <= gain[a] + 1e-9 * abs(gain[a]):
            b = a
        pair[b] += out
        pair[:, b] += into
        pair[b, b] += n
        at[w] = b
    return at, pair, float(count[at != old].sum() / max(1.0, count.sum()))


def settled(seqs: DataFrame, types: Types, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes, class bigrams) of the core once exchange has come to rest."""
    best, before = None, -np.inf
    while True:
        seen = core_contexts(seqs, types, np.append(at, [-1, 0]))
        if (at >= 0).all():
            pair = core_bigrams(seen, at)
            now = likelihood(pair)
            if now <= before:
                return best
            best, before = (at, pair), now
        at, pair, moved = core_exchange(seen, at)
        if moved < STILL:
            return at, pair


def contexts(rows: DataFrame, types: Types, at: np.ndarray) -> DataFrame:
    """(h, l, slot, n) for the words outside the core in the training rows."""

    def of(texts):
        one, two, kind, slot = neighbours(types, at, texts)
        mine = kind == types.rest
        return [one[mine], two[mine], slot[mine]], np.ones(int(mine.sum()), np.int64)

    each = lambda batches: summed(batches, of, ["h", "l", "slot"])
    return rows.where("not held_out").select("data").mapInArrow(each, "h long, l long, slot int, n long").groupBy("h", "l", "slot").agg(F.sum("n").alias("n"))


class Placer:
    """Best classes of words by their own contexts, against the class bigrams of the core words."""

    def __init__(self, pair: np.ndarray, default: int = 1):
        self.pair, self.row, self.col, self.diag = pair, pair.sum(axis=1), pair.sum(axis=0), np.diag(pair)
        self.open = self.row + self.col > 0  # a class without core words tells nothing
        self.open[0], self.open[default] = False, True
        self.first = np.zeros(CLASSES)
        self.first[default] = 1e-9  # where neighbours say nothing
        self.few = np.stack([self.step(np.arange(2 * CLASSES), np.full(2 * CLASSES, k)) for k in range(33)])

    @staticmethod
    def f(x):
        return x * np.log(np.maximum(x, 1))

    def step(self, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What n more in a slot adds to the cells, for each class that the word may join."""
        x = np.where((slot < CLASSES)[:, None], self.pair[slot % CLASSES], self.pair.T[slot % CLASSES])
        return self.f(x + n[:, None]) - self.f(x)

    def best(self, first: np.ndarray, slot: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, count) of the words whose contexts begin at first."""
        word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(slot))))
        grid = np.zeros((len(first), REST + 1))
        grid[word, slot] = n
        gains = np.zeros((len(slot), CLASSES))
        small, large = (n < len(self.few)) & (slot < OWN), (n >= len(self.few)) & (slot < OWN)
        gains[small] = self.few[n[small], slot[small]]
        gains[large] = self.step(slot[large], n[large])
        gain = np.add.reduceat(gains, first)
        into, out, own = grid[:, :CLASSES], grid[:, CLASSES:OWN], grid[:, OWN : OWN + 1]
        f, d = self.f, self.diag
        gain += f(d + out + into + own) - f(d + out) - f(d + into) + f(d)
        row, col = self.row + into, self.col + out  # what leads to the word or from it counts wherever it goes
        gain -= f(row + out.sum(axis=1, keepdims=True) + own) - f(row) + f(col + into.sum(axis=1, keepdims=True) + own) - f(col)
        gain += self.first
        gain[:, ~self.open] = -np.inf
        return gain.argmax(axis=1), (into.sum(axis=1) + own[:, 0] + grid[:, REST]).astype(np.int64)


def placed(rows: DataFrame, types: Types, at: np.ndarray, pair: np.ndarray, default: int) -> DataFrame:
    """(h, l, class, c) of every word of the training rows outside the core."""

    def each(batches):
        placer, held, size = Placer(pair, default), [], 0

        def out(upto_end: bool):
            h, l, s, n = (np.concatenate(x) for x in zip(*held, strict=True))
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (l[1:] != l[:-1])))
            stop = len(h) if upto_end else int(first[-1])  # the last word may go on; it has REST + 1 rows at most
            rest = [(h[stop:], l[stop:], s[stop:], n[stop:])]
            first = first[first < stop]
            if not len(first):
                return None, rest
            k, c = placer.best(first, s[:stop], n[:stop])
            return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(l[first]), pa.array(k.astype(np.int32)), pa.array(c)], ["h", "l", "class", "c"]), rest

        for b in batches:
            held.append(tuple(b.column(k).to_numpy() for k in range(4)))
            size += b.num_rows
            if size >= 1 << 14:
                got, held = out(False)
                size = len(held[0][0])
                if got is not None:
                    yield got
        if size:
            yield out(True)[0]

    near = contexts(rows, types, at)
    return cut(near.repartition("h", "l").sortWithinPartitions("h", "l").mapInArrow(each, "h long, l long, class int, c long"))


class Lexicon:
    """Classes and counts of words; what isn't in it is in the table of all words, or unknown."""

    def __init__(self, ends: int, default: int, h, l, c, k):
        self.ends, self.default = ends, default
        self.table = Table(max(16, 1 << int(len(h)).bit_length()))
        self.table.add(h, l, c.astype(np.int64) << 8 | k)


class Model:
    def __init__(self, pair: np.ndarray, kinds: np.ndarray, words: int):
        """pair: counts of (last class, class); kinds: distinct words of each class; words: of all, the end included."""
        size = pair.sum(axis=0)
        self.total = float(pair.sum())
        self.unigram = 1 / (self.total + 0.1 * (words + 1))
        prior = size / self.total if self.total else np.full(CLASSES, 1 / CLASSES)
        step = (pair + B * prior) / (pair.sum(axis=1, keepdims=True) + B)
        self.step = np.log10(SHARE * step / (size + A * (kinds + 1)) + (1 - SHARE) * self.unigram)


def above(words: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` words have it or more, to within a hundredth; from a histogram of counts."""
    step = F.floor(F.log("c") * 100).cast("int")
    held, edge = 0, None
    for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect():  # a few thousand steps at most
        held += r["n"]
        if held > most:
            break
        edge = r["c"]
    return edge if edge is not None else 1 << 62


def fit(rows: DataFrame) -> tuple[Lexicon, DataFrame, np.ndarray]:
    """The lexicon of the core and of frequent words, all words outside the core, and distinct words by class, of source(docs)."""
    words = vocabulary(rows)
    n = words.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    top = words.where(F.col("c") >= max(1, -(-n // CORE))).select("h", "l", "c").toArrow()  # at most CORE words
    unsigned = lambda t, k: t[k].to_numpy().astype(np.int64).view(np.uint64)
    h, l, c = unsigned(top, "h"), unsigned(top, "l"), top["c"].to_numpy()
    order = np.lexsort((l, h, -c))
    h, l, c = h[order], l[order], c[order]
    types, seeds = Types(h, l), min(SEEDS, len(h))
    seqs = numbered(rows, types)
    first = exchange(bigrams(seqs, types, seeds))
    at = np.full(types.core, -1)
    at[:seeds] = first[:seeds]
    at, pair = settled(seqs, types, at) if len(h) else (at, None)
    kinds = np.bincount(at, minlength=CLASSES).astype(float)
    others = placed(rows, types, np.append(at, [-1, 0]), pair, int(kinds.argmax())) if len(h) else cut(words.select("h", "l", F.lit(1).alias("class"), "c"))
    release(words, seqs)
    for r in others.groupBy("class").count().collect():  # CLASSES rows
        kinds[r["class"]] += r["count"]
    default = int(kinds[1:].argmax()) + 1
    ends = rows.where("not held_out").count()
    kinds[0] = 1.0 if ends else 0.0
    head = others.where(F.col("c") >= above(others, HEAD)).toArrow()  # at most HEAD words
    every = lambda a, k: np.concatenate([a, k])
    return Lexicon(ends, default, every(h, unsigned(head, "h")), every(l, unsigned(head, "l")), every(c, head["c"].to_numpy()), every(at, head["class"].to_numpy())), others, kinds


_ROW = "id long, tie int, kind int, pos int, class int, c long, doc_id long, held_out boolean, seq binary, logs double, n_known long"


def classed(rows: DataFrame, lexicon: Lexicon, others: DataFrame) -> DataFrame:
    """(doc_id, held_out, seq, logs, n_known) of every row: the classes of its words, a byte each, and the sums of its known words."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)  # CORE + HEAD words at most

    def once(b, names: set, again: dict | None = None):
        """The rows whose names are new to this task; repeats of others are counted."""
        fresh = []
        if len(names) > 1 << 17:
            names.clear()
        for k, name in enumerate(zip(b["id"].to_pylist(), b["tie"].to_pylist(), strict=True)):
            if name not in names:
                names.add(name)
                fresh.append(k)
            elif again is not None:
                again[name] = again.get(name, 0) + 1
        return b if len(fresh) == b.num_rows else b.take(pa.array(fresh, pa.int64()))

    def repeats(again: dict) -> pa.RecordBatch:
        n, (ids, ties) = len(again), zip(*again, strict=True)
        cols = [pa.array(ids, pa.int64()), pa.array(ties, pa.int32()), pa.array(np.full(n, 2, np.int32)), *[pa.array(np.zeros(n, np.int32))] * 2, pa.array(list(again.values()), pa.int64())]
        return pa.RecordBatch.from_arrays([*cols, *[pa.nulls(n, t) for t in (pa.int64(), pa.bool_(), pa.binary(), pa.float64(), pa.int64())]], [x.split()[0] for x in _ROW.split(", ")])

    def known(batches):
        m, names, again = shared.value, set(), {}
        for b, texts in slices((once(x, names, again) for x in batches), 4):
            doc, one, two = tokens(texts)
            found = m.table.find(one, two)
            there = found >= 0
            seq, size = np.where(there, found & 255, 255).astype(np.uint8).tobytes(), np.bincount(doc, minlength=len(texts))
            upto = np.concatenate(([0], np.cumsum(size))).tolist()
            logs = np.bincount(doc[there], np.log10((found[there] >> 8) + 0.1), len(texts)).astype(float)
            none = np.zeros(len(texts), np.int32)
            cols = [b.column(1), b.column(2), pa.array(none), pa.array(none), pa.array(none), pa.array(none + np.int64(1)), b.column(0), b.column(3)]
            cols += [pa.array([seq[s:e] for s, e in zip(upto, upto[1:], strict=False)], pa.binary()), pa.array(logs), pa.array(np.bincount(doc[there], minlength=len(texts)))]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _ROW.split(", ")])
            if len(again) > 1 << 17:
                yield repeats(again)
                again.clear()
        if again:
            yield repeats(again)

    def rare(batches):
        m, names = shared.value, set()
        for b, texts in slices((once(x, names) for x in batches), 2):
            doc, one, two = tokens(texts)
            out = m.table.find(one, two) < 0
            size = np.bincount(doc, minlength=len(texts))
            pos = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
            at = pa.array(doc[out].astype(np.int64))
            cols = [pa.array(one[out].view(np.int64)), pa.array(two[out].view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(pos[out].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["h", "l", "id", "tie", "pos"])

    def fill(batches):
        """Rows by name: texts, then their rare words, then repeats (kind 2, c of them); the last name of a part may go on in the next."""
        held, size, last = [], 0, None  # last: name, repeats, doc_id, held_out, logs, n_known, classes, logs and counts by place

        def part(last):
            t = pa.Table.from_batches(held)
            id_, tie, kind = (t[k].to_numpy() for k in ("id", "tie", "kind"))
            name = np.cumsum(np.append(last is None or (id_[0], tie[0]) != last[0], (id_[1:] != id_[:-1]) | (tie[1:] != tie[:-1]))) - (last is None)
            open_, text = [] if last is None else [last], np.flatnonzero(kind == 0)
            whole = np.flatnonzero(kind != 1)
            times = np.bincount(name[whole], t["c"].to_numpy()[whole], minlength=int(name[-1]) + 1)
            new = text[np.append(True, name[text][1:] != name[text][:-1])[: len(text)]]
            new = new[name[new] >= len(open_)]
            few = t.take(pa.array(new)).select(["id", "tie", "doc_id", "held_out", "logs", "n_known", "seq"]).to_pylist()
            open_ += [((r["id"], r["tie"]), 0, r["doc_id"], r["held_out"], r["logs"], r["n_known"], np.frombuffer(r["seq"], np.uint8), None, None) for r in few]
            upto = np.concatenate(([0], np.cumsum([len(o[6]) for o in open_])))
            seq, logs, seen = np.concatenate([o[6] for o in open_]), np.zeros(upto[-1]), np.zeros(upto[-1], bool)
            if last is not None:
                logs[: upto[1]], seen[: upto[1]] = last[7], last[8]
            w = np.flatnonzero(kind == 1)
            place, c = upto[name[w]] + t["pos"].to_numpy()[w], t["c"].to_numpy()[w]
            seq[place], logs[place], seen[place] = t["class"].to_numpy()[w], np.log10(c + 0.1), c > 0  # repeated rows write the same again
            return [(o[0], o[1] + int(k), *o[2:6], seq[s:e], logs[s:e], seen[s:e]) for o, k, s, e in zip(open_, times, upto, upto[1:], strict=False)]

        def out(done):
            for s in range(0, len(done), 512):
                rows_ = [(d, h, q.tobytes(), a + g.sum(), n + int(v.sum()), k) for _, k, d, h, a, n, q, g, v in done[s : s + 512]]
                cols = list(zip(*rows_, strict=True))
                kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["doc_id", "held_out", "seq", "logs", "n_known", "rows"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows * 64 + b.nbytes
            if size >= 1 << 22:
                *done, last = part(last)
                held, size = [], 0
                yield from out(done)
        if held:
            *done, last = part(last)
            yield from out(done)
        if last is not None:
            yield from out([last])

    one = rows.select("doc_id", "id", "tie", "held_out", "data").mapInArrow(known, _ROW)
    tail = rows.select("id", "tie", "data").mapInArrow(rare, "h long, l long, id long, tie int, pos int").join(others, ["h", "l"], "left")
    absent = [F.lit(None).cast(t).alias(k) for k, t in (("doc_id", "long"), ("held_out", "boolean"), ("seq", "binary"), ("logs", "double"), ("n_known", "long"))]
    two = tail.select("id", "tie", F.lit(1).alias("kind"), "pos", F.coalesce("class", F.lit(lexicon.default)).alias("class"), F.coalesce("c", F.lit(0)).alias("c"), *absent)
    both = one.unionByName(two).repartition("id", "tie").sortWithinPartitions("id", "tie", "kind")
    return cut(both.mapInArrow(fill, "doc_id long, held_out boolean, seq binary, logs double, n_known long, rows long"))


def steps(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(last class * CLASSES + class of each token in turn, ends included; where texts begin)."""
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    run = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8).astype(np.int64)  # the end is class 0
    return np.append(0, run[:-1]) * CLASSES + run, np.cumsum(size) - size


def class_bigrams(docs: DataFrame) -> np.ndarray:
    """Counts of (last class, class) over the training rows of classed rows."""

    def each(batches):
        seen = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            if b.num_rows:
                pair, first = steps(b.column(0).to_pylist())
                times = np.repeat(b.column(1).to_numpy(), np.diff(np.append(first, len(pair))))
                seen += np.bincount(pair, times, CLASSES * CLASSES).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], ["pair", "n"])

    out = np.zeros(CLASSES * CLASSES)
    for r in docs.where("not held_out").select("seq", "rows").mapInArrow(each, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # CLASSES**2 rows
        out[r["pair"]] = r["n"]
    return out.reshape(CLASSES, CLASSES)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    rows = source(docs)
    lexicon, others, kinds = fit(rows)
    found = classed(rows, lexicon, others)
    model = Model(class_bigrams(found), kinds, int(kinds.sum()))
    step, ends = model.step.ravel(), lexicon.ends

    def each(batches):
        for b in batches:
            if b.num_rows:
                pair, first = steps(b.column(2).to_pylist())
                size = np.diff(np.append(first, len(pair)))
                logs = b.column(3).to_numpy() + np.log10(ends + 0.1)
                seen = b.column(4).to_numpy() + (1 if ends else 0)
                cols = [pa.array(size), pa.array(seen), pa.array(logs), pa.array(np.add.reduceat(step[pair], first))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(5), *cols], ["doc_id", "held_out", "rows", "n_tokens", "n_known", "logs", "part"])

    one = found.select("doc_id", "held_out", "seq", "logs", "n_known", "rows").mapInArrow(each, "doc_id long, held_out boolean, rows long, n_tokens long, n_known long, logs double, part double")
    times = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("k")
    few = one.where(F.col("rows") <= HOT).select("*", times(F.col("rows")))
    parts = one.where(F.col("rows") > HOT).select("*", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("rows") - 1), F.lit(HOT).cast("long"))).alias("from")).repartition("doc_id", "from")
    many = parts.select(*one.columns, times(F.least(F.lit(HOT), F.col("rows") - F.col("from"))))
    return few.unionByName(many).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("n_tokens") * float(np.log10(model.unigram))).alias("base_score"), (F.col("logs") + F.col("part")).alias("score"),
    )
