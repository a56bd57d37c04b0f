"""Repeated substrings by a hash-compared suffix sort; every byte of a 200-byte string that starts twice goes.

Which suffixes meet. The anchor of a 200-byte window is the place of the least hash among its 64-byte grams (the leftmost of equals), so
equal windows have equal anchors at equal places, one anchor serves about 69 windows, and only anchors whose gram's hash
comes up again (counted by a grouped sum) can have repeated windows. An anchor's context is all that its windows can reach. Contexts
of equal bytes (told by 96 bits of BLAKE2b over them) with equal ends of text are copies: they are marked whole, and one of them stands for
them. Whole texts that occur again (told by SHA-256) are marked whole too. What is left in a group of one gram, edges of shared passages, is settled by the sort.

The sort. The windows' suffixes of many groups are sorted together: by their first eight bytes, then ties by a merge sort that
compares two suffixes with prefix polynomial hashes: a binary search finds their common extension in eight
look-ups, the byte after it decides. Neighbours that share 200 bytes are repeats, once their bytes have been compared too, so a collision
of polynomial hashes takes nothing away.

Hot groups. A group of over ``GROUP`` unequal contexts is dealt again by blocks of windows, ``BLOCKS`` wide in turn, counted by their distance to the anchor. All windows of a
block share some bytes, so equal windows are in the same block and those bytes name a smaller group. A group of one kind of block is left: alone it has no repeats, else it is marked whole.
One of several unequal kinds goes on: groups of up to ``GROUP`` kinds are sorted as above, larger ones are dealt again by narrower blocks. At one window a block is its window, so no two kinds are left.
A group of unequal windows is thus never decided but by the sort, and no sort holds more than ``GROUP`` records. Joins on hot keys are salted.

Text is its UTF-8 bytes; matches never cross rows. A null text is empty. Rows may repeat, in doc_id or whole: each is a
text of its own, and exact copies of 200 bytes or more are removed entirely. What is removed depends on texts alone, never on doc_id, which may be null or shared.
An empty table gives an empty result. Extra columns, of whatever name, are ignored by ``repeats`` and kept by ``strip``.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT, cut, parts_of, release, ship, sized, text_name
from .words import spread

SPAN, GRAM = 200, 64
REACH = SPAN - GRAM  # an anchor's place in its window is 0..REACH
SEGMENT, JOINT, GROUP = 1 << 20, 1 << 19, 512
BLOCKS = (64, 16, 4, 1)
BASES = (0x5851F42D4C957F2D, 0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, i < n at least."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            got = tuple(np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64)), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        _POWERS[base] = got
    return got


class Prefix:
    """Prefix polynomial hashes of a buffer: the hash of any substring in two look-ups."""

    def __init__(self, buf: np.ndarray, base: int):
        up, self.down = powers(base, len(buf) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], dtype=np.uint64)))

    def of(self, start, end) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def slide_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    m, w = h, 1
    while 2 * w <= width:
        m, w = np.minimum(m[:-w], m[w:]), 2 * w
    return np.minimum(m[: len(m) - (width - w)], m[width - w :]) if width > w else m


def anchors(buf: np.ndarray, windows: np.ndarray, prefix: Prefix) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor, first window, last window) of maximal runs of windows (starts, ascending) with one anchor."""
    n = len(buf) - GRAM + 1
    h = spread((prefix.sums[GRAM : GRAM + n] - prefix.sums[:n]) * prefix.down[:n])
    least = slide_min(h, REACH + 1)[windows]
    new = np.append(True, (least[1:] != least[:-1]) | (windows[1:] != windows[:-1] + 1))
    at = np.flatnonzero(new)
    first, last, value = windows[at], windows[np.append(at[1:], len(windows)) - 1], least[at]
    place = np.empty(len(first), np.int64)
    for i in range(0, len(first), 4096):
        s = slice(i, i + 4096)
        place[s] = first[s] + h[first[s][:, None] + np.arange(REACH + 1)].argmin(axis=1)
    tied = np.flatnonzero(last > place)  # equal hashes again: text that repeats itself
    if not len(tied):
        return value, place, first, last
    plain = np.flatnonzero(last <= place)
    out = [[x[plain]] for x in (value, place, first, last)]
    for k in tied.tolist():
        eq = first[k] + np.flatnonzero(h[first[k] : last[k] + REACH + 1] == value[k])
        ts = np.concatenate(([first[k]], eq + 1))
        ts = ts[ts <= last[k]]
        for o, x in zip(out, (np.full(len(ts), value[k]), eq[np.searchsorted(eq, ts)], ts, np.append(ts[1:] - 1, last[k])), strict=True):
            o.append(x)
    return tuple(np.concatenate(o) for o in out)


def pieces(texts: list[bytes]):
    """Buffers of whole texts up to about JOINT bytes, or of a part of a long one, as (buffer, text numbers, offset in the text of the
    buffer's begin, begins in the buffer, ends of text in the buffer, windows, where anchors that belong to it begin and end). An anchor's windows are never parted."""

    def joint(held):
        size = np.array([len(texts[k]) for k in held], np.int64)
        ends = np.cumsum(size)
        begins = ends - size
        buf = np.frombuffer(b"".join(texts[k] for k in held), np.uint8)
        count = size - SPAN + 1
        windows = np.arange(int(count.sum())) + np.repeat(begins - (np.cumsum(count) - count), count)
        return buf, np.array(held), 0, begins, ends, windows, 0, len(buf)

    held, total = [], 0
    for k, t in enumerate(texts):
        if len(t) < SPAN:
            continue
        if len(t) > 2 * SEGMENT:
            for s in range(0, len(t) - GRAM + 1, SEGMENT):
                a, b = max(0, s - 2 * SPAN), min(len(t), s + SEGMENT + 3 * SPAN)
                yield np.frombuffer(t[a:b], np.uint8), np.array([k]), a, np.array([0]), np.array([b - a]), np.arange(max(0, s - REACH), min(s + SEGMENT, len(t) - SPAN + 1)) - a, s - a, s - a + SEGMENT
            continue
        held.append(k)
        total += len(t)
        if total >= JOINT:
            yield joint(held)
            held, total = [], 0
    if held:
        yield joint(held)


def _digests(buf, starts, ends, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of BLAKE2b over each substring, as longs and ints; substrings of unequal shape differ."""
    view, of = memoryview(np.ascontiguousarray(buf)), hashlib.blake2b
    found = np.frombuffer(b"".join([of(view[s:e], digest_size=12).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]), "<u4").reshape(-1, 3)
    long = found[:, 0].astype(np.uint64) << np.uint64(32) | found[:, 1]
    return (long ^ spread(shape.astype(np.uint64))).view(np.int64), found[:, 2].astype(np.uint32).view(np.int32)


def _runs(ids, ties, texts, whole: bool = True):
    """Columns (h, c, d, id, tie, pos) of every anchor, or h alone; pos holds anchor << 16 | windows before << 8 | windows - 1."""
    for buf, k, offset, begins, ends, windows, least, most in pieces(texts):
        h, a, first, last = anchors(buf, windows, Prefix(buf, BASES[0]))
        own = (a >= least) & (a < most)
        h, a, first, last = h[own], a[own], first[own], last[own]
        if not whole:
            yield (h.view(np.int64),)
            continue
        own = np.searchsorted(begins, a, side="right") - 1
        left, right = np.maximum(begins[own], a - REACH), np.minimum(ends[own], a + SPAN)
        c, d = _digests(buf, left, right, (a - left) * 1024 + (right - a))
        pos = (a - begins[own] + offset) << 16 | (a - first) << 8 | (last - first)
        yield h.view(np.int64), c, d, ids[k[own]], ties[k[own]], pos


def source(docs: DataFrame) -> DataFrame:
    """(doc_id, id, tie, data): id and tie name a text; equal texts have one name."""
    text = F.coalesce("text", F.lit(""))
    id_, tie = text_name(text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_.alias("id"), tie.alias("tie"), F.encode(text, "UTF-8").alias("data"))


def _batches(it, size: int = 4 * JOINT):
    """Slices of record batches, so that few texts are unpacked at a time."""
    for b in it:
        s = 0
        while s < b.num_rows:
            n = 64
            yield b.slice(s, n)
            s += n


def common(prefix: Prefix, i: np.ndarray, j: np.ndarray, most: int = SPAN) -> np.ndarray:
    """Length of the common extension of suffixes i and j, up to most, by binary search over hashes."""
    n = np.zeros(len(i), np.int64)
    step = 1 << (most.bit_length() - 1)
    while step:
        to = n + step
        ok = to <= most
        e = np.where(ok, to, n)
        same = ok & (prefix.of(i + n, i + e) == prefix.of(j + n, j + e))
        n = np.where(same, to, n)
        step >>= 1
    return n


def suffix_sort(buf: np.ndarray, starts: np.ndarray, prefix: Prefix) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): the suffixes in order of their first SPAN bytes, and whether each shares them with the one before."""
    big = np.zeros(len(starts), np.uint64)
    for k in range(8):
        big = big << np.uint64(8) | buf[starts + k].astype(np.uint64)
    order = np.argsort(big, kind="stable")
    key = big[order]
    group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1  # ties are merged within their group alone
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    place = np.arange(len(order)) - begin[group]
    size = np.diff(np.append(begin, len(order)))
    width = 1
    while len(size) and width < size.max():
        live = np.flatnonzero(size[group] > width)  # groups in which runs are left to merge
        run = place[live] // width
        base = begin[group[live]]
        other = np.where(run % 2 == 0, run + 1, run - 1) * width
        lo = np.minimum(base + other, base + size[group[live]])
        hi = np.minimum(base + other + width, base + size[group[live]])
        stop, from_left = hi.copy(), run % 2 == 0
        first = lo.copy()
        me = starts[order[live]]
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) // 2
            them = starts[order[mid]]
            n = common(prefix, me[todo], them)
            at = np.minimum(n, SPAN - 1)
            a, b = buf[me[todo] + at], buf[them + at]
            # equal ones keep their order: those of the left run come first
            after = np.where(n == SPAN, ~from_left[todo], a > b)
            lo[todo] = np.where(after, mid + 1, lo[todo])
            hi[todo] = np.where(after, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        rank = lo - np.minimum(first, stop)
        to = base + (run // 2) * 2 * width + place[live] % width + rank
        moved = order[live]
        order[to] = moved
        width *= 2
    shared = np.zeros(len(order), bool)
    if len(order) > 1:
        i, j = starts[order[:-1]], starts[order[1:]]
        near = np.flatnonzero((group[1:] == group[:-1]))
        near = near[common(prefix, i[near], j[near]) == SPAN]
        reach = np.arange(SPAN)
        for s in range(0, len(near), 8192):
            part = near[s : s + 8192]
            shared[part + 1] = (buf[i[part][:, None] + reach] == buf[j[part][:, None] + reach]).all(axis=1)
    return order, shared


def _spans(found: np.ndarray, record: np.ndarray, first: np.ndarray, t: np.ndarray):
    """(record, begin, end) of maximal runs of found windows; t: a window's number within its record."""
    w = np.flatnonzero(found)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.append(True, (w[1:] != w[:-1] + 1) | (record[w[1:]] != record[w[:-1]]))
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(w)) - 1
    r = record[w[s]]
    return r, first[r] + t[w[s]], first[r] + t[w[e]] + SPAN


def _unpacked(b):
    """A batch of records as (buffer, first windows, record of each window, its number in the record, its start in the buffer)."""
    n, first = b["n"].to_numpy().astype(np.int64), b["t"].to_numpy()
    data = b["data"].to_pylist()
    size = np.fromiter(map(len, data), np.int64, len(data))
    begins = np.cumsum(size) - size
    record = np.repeat(np.arange(len(n)), n)
    t = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.frombuffer(b"".join(data), np.uint8), first, record, t, begins[record] + t


def _settle(it):
    """Whole groups (g, m), many at a time: their windows in one suffix sort."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def close(last_too: bool):
        nonlocal held, rows
        t = pa.Table.from_batches(held).combine_chunks()
        g, m = t["g"].to_numpy(), t["m"].to_numpy()
        n = t.num_rows if last_too else int(np.argmax((g == g[-1]) & (m == m[-1])))  # the last group may go on
        own, held = t.slice(0, n), t.slice(n).to_batches()
        rows = t.num_rows - n
        for b in own.combine_chunks().to_batches():
            buf, first, record, at, starts = _unpacked(b)
            # equal windows of different groups are equal all the same: both are repeats
            order, shared = suffix_sort(buf, starts, Prefix(buf, BASES[0]))
            found = np.zeros(len(starts), bool)
            found[order] = shared | np.append(shared[1:], False)
            r, s, e = _spans(found, record, first, at)
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(r)), b["tie"].take(pa.array(r)), pa.array(s), pa.array(e)], ["id", "tie", "s", "e"])

    for b in it:
        for s in range(0, b.num_rows, 2048):
            held.append(b.slice(s, 2048))
            rows += held[-1].num_rows
            if rows >= 2048:
                yield from close(False)
    if rows:
        yield from close(True)


_SPANS = "id long, tie int, s long, e long"


def _sorted(records: DataFrame) -> DataFrame:
    """Spans of the repeated windows of each group (g, m) of records (id, tie, t, n, data)."""
    return records.select("g", "m", "id", "tie", "t", "n", "data").repartition("g", "m").sortWithinPartitions("g", "m").mapInArrow(_settle, _SPANS)


def _blocks(width: int, narrower: bool):
    """A row for each block of ``width`` windows of a hot record, or of those in its open ranges of distances: (k, l) are
    digests of the bytes that all windows of the block share, (u, v) of all that the record's own windows of it span."""

    def each(it):
        for b in _batches(it):
            high = b["b"].to_numpy().astype(np.int64)
            low = high - b["n"].to_numpy() + 1
            data = b["data"].to_pylist()
            size = np.fromiter(map(len, data), np.int64, len(data))
            begins = np.cumsum(size) - size
            if narrower:
                count = pa.compute.list_value_length(b["open"]).to_numpy()
                r = np.repeat(np.arange(len(data)), count)
                of = b["open"].flatten().to_numpy()
                low, high = np.maximum(low[r], of >> 16), np.minimum(high[r], of & 65535)
            else:
                r = np.arange(len(data))
            each_has = high // width - low // width + 1
            which = np.repeat(np.arange(len(r)), each_has)
            block = np.arange(int(each_has.sum())) - np.repeat(np.cumsum(each_has) - each_has, each_has) + (low // width)[which]
            r, low, high = r[which], low[which], high[which]
            near, far = block * width, np.minimum(block * width + width - 1, REACH)
            own_near, own_far = np.maximum(near, low), np.minimum(far, high)
            anchor = begins[r] + b["b"].to_numpy().astype(np.int64)[r]
            buf, h = np.frombuffer(b"".join(data), np.uint8), b["h"].to_numpy().view(np.uint64)[r]
            k, l = _digests(buf, anchor - near, anchor - far + SPAN, spread(h) + (near * 1024 + far).astype(np.uint64))
            u, v = _digests(buf, anchor - own_far, anchor - own_near + SPAN, spread(h) + (own_far * 1024 + own_near).astype(np.uint64))
            t, who = b["t"].to_numpy()[r], pa.array(r)
            s = t + b["b"].to_numpy().astype(np.int64)[r] - own_far
            span = pa.array(own_near << 16 | own_far)
            cols = [pa.array(k), pa.array(l), pa.array(u), pa.array(v), b["many"].take(who), b["h"].take(who), b["id"].take(who), b["tie"].take(who), pa.array(t), span, pa.array(s), pa.array(s + own_far - own_near + SPAN)]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _BLOCK.split(", ")])

    return each


_BLOCK = "k long, l int, u long, v int, many long, h long, id long, tie int, t long, span long, s long, e long"


def _cropped(it):
    """The windows of a record whose distances its span names, as a record."""
    for b in _batches(it):
        far, near = b["span"].to_numpy() & 65535, b["span"].to_numpy() >> 16
        skip = b["b"].to_numpy().astype(np.int64) - far
        n = far - near + 1
        data = [x[a : a + c + SPAN - 1] for x, a, c in zip(b["data"].to_pylist(), skip.tolist(), n.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b["g"], b["m"], b["id"], b["tie"], pa.array(b["t"].to_numpy() + skip), pa.array(n.astype(np.int32)), pa.array(data, pa.binary())], ["g", "m", "id", "tie", "t", "n", "data"])


def _hot(hot: DataFrame, group: int, scratch: list) -> list[DataFrame]:
    """Spans (id, tie, s, e) of the repeated windows of hot records, in parts."""
    out, asking = [], hot
    for width in BLOCKS:
        rows = cut(asking.mapInArrow(_blocks(width, asking is not hot), _BLOCK))
        kinds = cut(rows.groupBy("k", "l", "u", "v").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("many"), F.min(F.struct("h", "id", "tie", "t", "span")).alias("one")))
        scratch += [rows, kinds]
        # a key holds no more rows than its gram's group: many is that group's number of rows
        out.append(sized(rows, ["k", "l", "u", "v"], "many", ["id", "tie", "t"]).select("id", "tie", "s", "e"))
        some = cut(sized(kinds.select("k", "l", "u", "v", "many", "one"), ["k", "l"], "many", ["u", "v"]).select("k", "l", "one.*", F.col("size").alias("kinds")))
        scratch.append(some)
        if some.isEmpty():
            break
        key = ["h", "id", "tie", "t"]
        few = some.where(F.col("kinds") <= group).select(F.col("k").alias("g"), F.col("l").cast("long").alias("m"), *key, "span")
        taken = hot.drop("many", "n").join(few, key).select("g", "m", "id", "tie", "t", "b", "span", "data").mapInArrow(_cropped, "g long, m long, id long, tie int, t long, n int, data binary")
        out.append(_sorted(taken))
        still = some.where(F.col("kinds") > group).groupBy(*key).agg(F.collect_list("span").alias("open"))  # one record's blocks
        asking = hot.join(still, key)
    return out


def marks(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(id, tie, spans array<struct<s, e>>): the bytes to remove of each text of source(docs) that loses some; spans overlap."""
    spark = docs.sparkSession
    ship(spark)
    src = source(docs)

    def find(whole: bool):
        def each(it):
            seen: set = set()  # names of this task's texts: copies add nothing, and may be many
            for b in _batches(it):
                ids, ties = b.column(0).to_numpy(), b.column(1).to_numpy()
                fresh = []
                for k, name in enumerate(zip(ids.tolist(), ties.tolist(), strict=True)):
                    if name not in seen:
                        seen.add(name)
                        fresh.append(k)
                if len(seen) > 1 << 17:
                    seen.clear()
                if fresh:
                    texts = b.column(2).take(pa.array(fresh)).to_pylist()
                    for cols in _runs(ids[fresh], ties[fresh], texts, whole):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "c", "d", "id", "tie", "pos"][: len(cols)])

        return each

    long = src.where(F.length("data") >= SPAN)
    again = cut(long.select("id", "tie", "data").mapInArrow(find(False), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("many")).where("many > 1"))
    every = long.select("id", "tie", "data").mapInArrow(find(True), "h long, c long, d int, id long, tie int, pos long")
    met = cut(every.join(again, "h"))
    tidy(spark)
    kinds = cut(met.groupBy("h", "c", "d").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("many"), F.min(F.struct("id", "tie", "pos")).alias("one")))
    mixed = cut(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.max("many").alias("many")).where("kinds > 1"))
    few = met.where(F.col("many") <= HOT).join(kinds.where((F.col("many") <= HOT) & (F.col("n") > 1)).select("h", "c", "d"), ["h", "c", "d"])
    copies = few.drop("many").unionByName(sized(met.where(F.col("many") > HOT), ["h", "c", "d"], "many", ["id", "tie", "pos"]).drop("many", "size"))
    copies = copies.select("id", "tie", (F.shiftright("pos", 16) - REACH).alias("s"), (F.shiftright("pos", 16) + SPAN).alias("e"))
    # one row a gram on the right: copying it to the parts of a hot gram adds a row for each HOT rows
    part = lambda x: F.pmod(F.xxhash64(*x), parts_of(F.col("many"))).cast("int").alias("part")
    spread_out = mixed.select("h", "kinds", F.explode(F.sequence(F.lit(0), parts_of(F.col("many")) - 1)).alias("part"))
    edges = kinds.select("h", "one.*", part(["one.id", "one.tie", "one.pos"])).join(spread_out, ["h", "part"])
    edges = edges.select("h", F.when(F.col("kinds") > group, F.col("kinds")).otherwise(0).alias("many"), "id", "tie", "pos")
    asked = edges.groupBy("id", "tie").agg(F.collect_list(F.struct("h", "many", "pos")).alias("own"))  # anchors of one text

    def excerpts(it):
        """An anchor's windows as bytes: its first window's start, how many windows, and the bytes that they span."""
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for b in _batches(it):
            out: list[list] = [[] for _ in types]
            for r in b.to_pylist():
                for e in r["own"]:
                    a, before, more = e["pos"] >> 16, e["pos"] >> 8 & 255, e["pos"] & 255
                    t = a - before
                    for o, v in zip(out, (e["h"], e["many"], r["id"], r["tie"], t, before, more + 1, r["data"][t : t + more + SPAN]), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], ["h", "many", "id", "tie", "t", "b", "n", "data"])

    one_each = long.groupBy("id", "tie").agg(F.first("data").alias("data"))  # copies of a text shrink before they are shuffled
    taken = cut(one_each.join(asked, ["id", "tie"]).mapInArrow(excerpts, "h long, many long, id long, tie int, t long, b int, n int, data binary"))
    tidy(spark)
    cold = taken.where("many = 0").select(F.col("h").alias("g"), F.lit(0).cast("long").alias("m"), "id", "tie", "t", "n", "data")
    scratch: list[DataFrame] = []
    hot = taken.where("many > 0")
    twins = long.groupBy("id", "tie").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("data")).alias("e")).where("n > 1").select("id", "tie", F.lit(0).cast("long").alias("s"), F.col("e").cast("long").alias("e"))
    found = [copies, _sorted(cold), twins, *([] if hot.isEmpty() else _hot(hot, group, scratch))]
    out = cut(reduce(DataFrame.unionByName, found).groupBy("id", "tie").agg(F.collect_set(F.struct("s", "e")).alias("spans")))
    release(again, met, kinds, mixed, taken, *scratch)
    tidy(spark)
    return out


def tidy(spark) -> None:
    """Shuffle files of finished jobs go once the driver's garbage is collected."""
    spark.sparkContext._jvm.System.gc()


def kept(data: bytes, spans) -> tuple[list[tuple[int, int]], bytes]:
    """(maximal removed runs, remaining bytes)."""
    runs: list[list[int]] = []
    for s, e in sorted((max(0, x["s"]), min(len(data), x["e"])) for x in spans or ()):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    out, at = [], 0
    for s, e in runs:
        out.append(data[at:s])
        at = e
    return [tuple(r) for r in runs], b"".join([*out, data[at:]])


def repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs (doc_id, text)."""

    def each(it):
        for b in _batches(it):
            out: list[list] = [[], [], [], []]
            for data, spans in zip(b["data"].to_pylist(), b["spans"].to_pylist(), strict=True):
                runs, rest = kept(data, spans)
                for o, v in zip(out, (len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest()), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(o, pa.int64()) for o in out[:3]], pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return source(docs).join(marks(docs, group), ["id", "tie"], "left").select("doc_id", "data", "spans").mapInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """docs with the repeats taken out of text (a character that loses a byte goes) and n_chars, if there is one, set anew."""
    id_, tie = text_name(F.coalesce("text", F.lit("")))
    named = docs.select(F.struct("*").alias("row"), id_.alias("id"), tie.alias("tie"))
    both = named.join(marks(docs, group), ["id", "tie"], "left")
    cols = docs.columns

    def each(it):
        for b in _batches(it):
            row = dict(zip(cols, b["row"].flatten(), strict=True))
            spans = b["spans"].to_pylist()
            text = [t if t is None or not s else kept(t.encode(), s)[1].decode("utf-8", "ignore") for t, s in zip(row["text"].to_pylist(), spans, strict=True)]
            if "n_chars" in cols:
                row["n_chars"] = pa.array([old if s is None or t is None else len(t) for t, s, old in zip(text, spans, row["n_chars"].to_pylist(), strict=True)], row["n_chars"].type)
            row["text"] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays([row[c] for c in cols], cols)

    return both.select("row", "spans").mapInArrow(each, docs.schema)
