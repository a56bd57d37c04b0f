"""Exact top-k inner products through a KD-tree for each shard.

Components become floor(1024 * x). Space is split at medians of the widest side into at most ``REGIONS`` regions, on a bounded sample (``SAMPLE_VALUES`` numbers); a region's rows are
dealt to shards of about ``SHARD_ROWS``, so that a region of copies has many, and its tight box over all its rows is known to every task (two vectors a region). Each shard's
tree splits at medians of the widest side and holds tight bounding boxes. A box bounds a query's product by the better corner of each side. A query starts in the region of best bound, in one of its shards, whose
kth score goes with it; queries of one region travel in blocks of about ``BLOCK_ROWS``, and a block is sent only to regions whose bound reaches the kth score of some of its queries. There
nodes are taken best bound first until no bound reaches the kth score; within a task it rises from shard to shard. Bounds equal to the kth score are still opened, as a tie may have a smaller id.

Vectors that are null, empty or hold null or non-finite components, and rows without vec_id, take no part. A vec_id names a row: rows of one
vec_id never answer each other, and repeated rows count once. Vectors of different length don't meet. A product beyond a long counts as the nearest long.
Fewer than k candidates give all of them; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship
from .vectors import best, blobs, matrix, sample_of, unpack, valid

K, EVERY, SHARD_ROWS, BLOCK_ROWS, LEAF, REGIONS, SAMPLE_VALUES = 10, 100, 4096, 512, 64, 1024, 1 << 21


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x); a product beyond doubles is the largest double."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(1024.0 * x))


class Tree:
    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.lo, self.hi, self.span, self.below = [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = x[self.order[a:b]]
            me = len(self.span)
            if parent >= 0:
                self.below[parent].append(me)
            lo, hi = own.min(axis=0), own.max(axis=0)
            self.lo.append(lo), self.hi.append(hi), self.span.append((a, b)), self.below.append([])
            if b - a > leaf and (hi > lo).any():
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, int((hi - lo).argmax())], mid)]
                todo += [(a, a + mid, me), (a + mid, b, me)]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of each query's product in each node."""
        return bounds(self.lo, self.hi, q)


def dots(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products as int64: by doubles while every sum stays under 2**53, by longs while under 2**63, else by integers of any size, held at the ends of a long."""
    with np.errstate(over="ignore"):
        most = x.shape[1] * float(np.abs(x).max()) * float(np.abs(q).max()) if x.size else 0.0
    if most < 2**53:
        return (x @ q).astype(np.int64)
    if most < 2**63:
        return x.astype(np.int64) @ q.astype(np.int64)
    own = [int(b) for b in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, own, strict=True)), -(2**63)), 2**63 - 1) for row in x], np.int64)


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, kth: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of up to k best for each query; kth: scores below it can't be among the query's k best. It is raised in place."""
    x = x[tree.order]
    ids = ids[tree.order]
    bound = tree.bounds(queries)
    found = []
    for i, q in enumerate(queries):
        heap, got_s, got_i, floor = [(-bound[i, 0], 0)], np.zeros(0, np.int64), np.zeros(0, np.int64), kth[i]
        while heap:
            b, node = heapq.heappop(heap)
            if -b < floor:
                break
            if tree.below[node]:
                for n in tree.below[node]:
                    if bound[i, n] >= floor:
                        heapq.heappush(heap, (-bound[i, n], n))
                continue
            s, e = tree.span[node]
            score = dots(x[s:e], q)
            ok = (score >= floor) & (ids[s:e] != query_ids[i])
            if ok.any():
                got_s, got_i = np.concatenate((got_s, score[ok])), np.concatenate((got_i, ids[s:e][ok]))
                if len(got_s) > k:
                    top = np.lexsort((got_i, -got_s))[:k]
                    got_s, got_i = got_s[top], got_i[top]
                if len(got_s) >= k:
                    floor = max(floor, float(got_s.min()))
        kth[i] = floor
        found.append((got_i, got_s))
    return found


class Regions:
    """Median splits of a sample's widest sides: a region for each leaf."""

    def __init__(self, x: np.ndarray, most: int):
        self.axis, self.at, self.below = [], [], []
        todo, self.count = [(x, most, -1, 0)], 0
        while todo:
            own, share, parent, side = todo.pop()
            spread = own.max(axis=0) / 2 - own.min(axis=0) / 2
            axis = int(spread.argmax())
            cut_ = float(np.median(own[:, axis]))
            low = own[:, axis] <= cut_
            leaf = share < 2 or not low.any() or low.all()
            if parent >= 0:
                self.below[parent][side] = -1 - self.count if leaf else len(self.axis)
            if leaf:
                self.count += 1
                continue
            me = len(self.axis)
            self.axis.append(axis), self.at.append(cut_), self.below.append([0, 0])
            todo += [(own[low], share // 2, me, 0), (own[~low], share - share // 2, me, 1)]

    def of(self, x: np.ndarray) -> np.ndarray:
        if not self.axis:
            return np.zeros(len(x), np.int64)
        axis, at, below = np.array(self.axis), np.array(self.at), np.array(self.below)
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (live := node >= 0).any():
            n = node[live]
            node[live] = below[n, (x[rows[live], axis[n]] > at[n]).astype(int)]
        return -1 - node


def bounds(lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Upper bound of each query's product in each box, widened by more than rounding can take."""
    with np.errstate(over="ignore", invalid="ignore"):
        b = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
        size = np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T  # rounding goes with the terms, not with their sum
        return np.nan_to_num(b + size * 1e-12 * (size >= 2**50), nan=np.inf, posinf=np.inf, neginf=-np.inf)


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x, np.float64).tobytes()], pa.binary())


def top_k(rows: DataFrame, k: int = K, every: int = EVERY, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, regions: int = REGIONS) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows (vec_id, embedding) whose vec_id is divisible by every."""
    return best(_found(rows, k, every, shard_rows, block_rows, regions)[0], k)


def visits(rows: DataFrame, k: int = K, every: int = EVERY, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, regions: int = REGIONS) -> tuple[int, int]:
    """(pairs of a block of queries and a shard that are searched, all such pairs)."""
    _, sent, blocks, shards = _found(rows, k, every, shard_rows, block_rows, regions)
    n = blocks.groupBy("dim").count().withColumnRenamed("count", "n")
    return sent.count(), n.join(shards, "dim").agg(F.coalesce(F.sum(F.col("n") * F.col("many")), F.lit(0))).first()[0]


def _found(rows: DataFrame, k: int, every: int, shard_rows: int, block_rows: int, most: int):
    """(answers of shards, blocks sent to shards, blocks, shards by region)."""
    spark = rows.sparkSession
    ship(spark)
    v = valid(rows).withColumn("dim", F.size("v"))
    n = v.count()
    maps = {d: Regions(whole(x), min(most, -(-n // shard_rows))) for d, (_, x) in sample_of(v, SAMPLE_VALUES).items()}
    shared = spark.sparkContext.broadcast(maps)  # a number and an axis for each region

    def locate(batches):
        for b in batches:
            dims, out = b.column(2).to_numpy(), np.zeros(b.num_rows, np.int64)
            for d in np.unique(dims):
                if int(d) in shared.value:
                    own = dims == d
                    out[own] = shared.value[int(d)].of(whole(matrix(b.column(1).filter(pa.array(own)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], ["vec_id", "v", "dim", "region"])

    placed = cut(v.select("vec_id", "v", "dim").distinct().mapInArrow(locate, "vec_id long, v array<double>, dim int, region long"))
    shards = cut(placed.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("long").alias("many")))
    part = lambda m: F.pmod(F.xxhash64("vec_id", "v"), m)
    gathered = blobs(placed.join(shards, ["dim", "region"]).withColumn("part", part(F.col("many"))), ["part", "dim", "region"], whole, ["region"])
    index = cut(gathered.select("region", "part", "dim", "ids", "vectors"))

    def box(batches):
        """The box of each region's rows of a task."""
        held: dict = {}
        for b in batches:
            for r in b.to_pylist():
                _, x = unpack(r["ids"], r["vectors"], r["dim"])
                lo, hi = held.get((r["dim"], r["region"]), (x[0], x[0]))
                held[r["dim"], r["region"]] = np.minimum(lo, x.min(axis=0)), np.maximum(hi, x.max(axis=0))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.int32()), pa.array([g for _, g in held], pa.int64()), pa.array([np.stack(x).tobytes() for x in held.values()], pa.binary())], ["dim", "region", "box"])

    def merge(t: pa.Table) -> pa.Table:
        both = np.stack([np.frombuffer(x, np.float64).reshape(2, -1) for x in t["box"].to_pylist()])
        return pa.table({"dim": t["dim"][:1], "region": t["region"][:1], "box": _bytes(np.stack([both[:, 0].min(axis=0), both[:, 1].max(axis=0)]))})

    of_tasks = index.select("dim", "region", "ids", "vectors").mapInArrow(box, "dim int, region long, box binary")
    boxes: dict = {}
    for r in of_tasks.groupBy("dim", "region").applyInArrow(merge, "dim int, region long, box binary").collect():  # two vectors a region
        boxes.setdefault(r["dim"], []).append((r["region"], *np.frombuffer(r["box"], np.float64).reshape(2, -1)))
    corners = spark.sparkContext.broadcast({d: (np.array([g for g, *_ in own]), np.stack([lo for _, lo, _ in own]), np.stack([hi for *_, hi in own])) for d, own in boxes.items()})

    def homes(batches):
        for b in batches:
            dims, out = b.column(2).to_numpy(), np.zeros(b.num_rows, np.int64)
            for d in np.unique(dims):
                own = dims == d
                region, lo, hi = corners.value[int(d)]
                out[own] = region[bounds(lo, hi, whole(matrix(b.column(1).filter(pa.array(own))))).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out)], ["vec_id", "v", "dim", "region"])

    asked = cut(placed.where(F.col("vec_id") % every == 0).select("vec_id", "v", "dim").mapInArrow(homes, "vec_id long, v array<double>, dim int, region long"))
    sizes = asked.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("blocks"))
    dealt = asked.join(sizes, ["dim", "region"]).withColumn("part", part(F.col("blocks")))
    queries = cut(blobs(dealt, ["part", "dim", "region"], whole, ["region"]).select(F.col("part").alias("block"), "region", "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))

    def home(batches):
        """The kth scores from one shard of the home region, and the regions that still may hold better ones."""
        for b in batches:
            for r in b.to_pylist():
                ids, x = unpack(r["ids"], r["vectors"], r["dim"])
                q_ids, q = unpack(r["q_ids"], r["q_vectors"], r["dim"])
                floor = np.full(len(q), -np.inf)
                search(Tree(x), x, ids, q, q_ids, k, floor)
                region, lo, hi = corners.value[r["dim"]]
                goes = region[(bounds(lo, hi, q) >= floor[:, None]).any(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (r["block"], r["home"])] + [pa.array([r["dim"]], pa.int32()), _bytes(floor), pa.array([goes.tolist()], pa.list_(pa.int64()))], ["block", "home", "dim", "kth", "goes"])

    def everywhere(batches):
        raised: dict = {}
        for b in batches:
            last, tree = None, None
            for r in b.to_pylist():
                ids, x = unpack(r["ids"], r["vectors"], r["dim"])
                if (r["region"], r["part"], r["dim"]) != last:
                    last, tree = (r["region"], r["part"], r["dim"]), Tree(x)
                q_ids, q = unpack(r["q_ids"], r["q_vectors"], r["dim"])
                kth = raised.pop((r["home"], r["block"], r["dim"]), None)
                if kth is None:
                    kth = np.frombuffer(r["kth"], np.float64).copy()
                out: list[list[np.ndarray]] = [[], [], []]
                for own, (i, s) in zip(q_ids, search(tree, x, ids, q, q_ids, k, kth), strict=True):
                    out[0].append(np.full(len(i), own)), out[1].append(i), out[2].append(s)
                raised[r["home"], r["block"], r["dim"]] = kth
                while len(raised) > 256:
                    raised.pop(next(iter(raised)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    at_home = queries.join(shards, ["dim", "region"]).withColumn("part", F.pmod(F.xxhash64("block"), F.col("many"))).join(index, ["dim", "region", "part"])
    seeds = cut(at_home.withColumn("home", F.col("region")).mapInArrow(home, "block long, home long, dim int, kth binary, goes array<bigint>"))
    goes = seeds.select("block", "home", "dim", F.explode("goes").alias("region")).join(shards, ["dim", "region"])
    sent = goes.select("block", "home", "dim", "region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("part"))
    own = queries.withColumnRenamed("region", "home").join(seeds.drop("goes"), ["block", "home", "dim"])
    found = sent.join(own, ["block", "home", "dim"]).join(index, ["dim", "region", "part"]).mapInArrow(everywhere, "query_id long, vec_id long, score long")
    return found, sent, queries, shards
