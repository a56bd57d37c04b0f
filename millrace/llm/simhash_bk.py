"""SimHash near-duplicates through sharded BK-trees.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, 3-word shingles with repeats; bit i is set
where more than half of the shingles' XXH64 (seed 42) have it. Fingerprints link at ``radius`` or fewer
differing bits; documents reach each other through links.

Shards: two fingerprints within ``radius`` 3 agree on one of four 16-bit blocks, so each fingerprint goes to the four
shards named by its blocks and no link is lost. Each shard builds one BK-tree, whose children are keyed by
their integer distance to the parent, and a search follows only edges within the radius. A tree stays in the
task of its shard: all trees together hold every fingerprint four times, and a broadcast would lead them through the driver. A shard above ``shard_rows`` is dealt
again by blocks of the remaining bits (four of 12, of 9, then of 7 or 6); the same argument keeps every link.
A shard returns a spanning forest, never its pairs.

Nulls: a null text is empty, and an empty text has fingerprint zero, which links like any other. A null
doc_id keeps its row; it counts for no component's smallest id (null if a component has no other).
Repeated rows stay repeated. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, components, cut, release, ship, text_name

SHINGLE, SEED, RADIUS, SHARD_ROWS = 3, 42, 3, 1024
WIDTHS = (16, 12, 9, 7)


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: 1 - SHINGLE - 1])) if len(words) > SHINGLE else np.zeros(1, np.int64)
        h = xxhash.xxh64_intdigest
        hashes = [h(whole[s:e], SEED) for s, e in zip(starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    found = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 16):
        counts += np.unpackbits(found[i : i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, named: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. named: and the name (id, tie) of each text."""
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    names = [c.alias(k) for c, k in zip(text_name(text), ("id", "tie"), strict=True)] if named else []

    def each(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            rest = range(2, b.num_columns)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *[b.column(k) for k in rest]], ["doc_id", "fp", *[b.schema.names[k] for k in rest]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *names).mapInArrow(each, "doc_id long, fp long" + (", id long, tie int" if named else ""))


class Tree:
    """A BK-tree over 64-bit integers."""

    def __init__(self, root: int):
        self.nodes, self.children = [root], [{}]

    def within(self, x: int, radius: int):
        """Nodes within the radius, as numbers in order of insertion."""
        found, todo = [], [0]
        nodes, children = self.nodes, self.children
        while todo:
            at = todo.pop()
            d = (nodes[at] ^ x).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if below:
                for k in range(max(d - radius, 0), d + radius + 1):
                    if k in below:
                        todo.append(below[k])
        return found

    def add(self, x: int) -> None:
        at = 0
        while True:
            d = (self.nodes[at] ^ x).bit_count()
            below = self.children[at]
            if d not in below:
                below[d] = len(self.nodes)
                self.nodes.append(x)
                self.children.append({})
                return
            at = below[d]


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct values."""
    tree, parent, edges = Tree(values[0]), [0], []

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, x in enumerate(values[1:], 1):
        parent.append(i)
        for j in tree.within(x, radius):
            a, b = top(i), top(j)
            if a != b:
                parent[b] = a
                edges.append((x, values[j]))
        tree.add(x)
    return edges


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) of a spanning forest over distinct fingerprints (fp): the links of every shard."""
    if not 0 <= radius <= 3:
        raise ValueError("four blocks find distances up to 3")

    def trees(batches):
        key, held, out = None, [], ([], [])

        def close():
            if len(held) > 1:
                for a, b in forest(held, radius):
                    out[0].append(a)
                    out[1].append(b)

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_numpy().view(np.uint64).tolist(), strict=True):
                if k != key:
                    close()
                    key, held = k, []
                held.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in out], ["a", "b"])
                out = ([], [])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in out], ["a", "b"])

    def dealt(df: DataFrame, level: int) -> DataFrame:
        """Each row once for each block of the bits that are left; left: those bits' place, from the lowest."""
        width, bits = WIDTHS[level], 64 - sum(WIDTHS[:level])
        name = lambda i: F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("rest", i * width).bitwiseAND((1 << width) - 1).alias("v"))
        each = df.withColumn("block", F.explode(F.array(*[name(i) for i in range(4)])))
        low = F.col("rest").bitwiseAND(F.expr(f"shiftleft(1L, block.i * {width}) - 1"))
        high = F.when(F.expr(f"(block.i + 1) * {width} >= {bits}"), F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(shiftrightunsigned(rest, (block.i + 1) * {width}), block.i * {width})"))
        # the key is exact: the blocks taken so far, 6 bits + width for each level
        return each.select(F.concat_ws("/", "key", F.concat_ws(":", "block.i", "block.v")).alias("key"), "fp", low.bitwiseOR(high).alias("rest"))

    rows, parts = distinct.select(F.lit("").alias("key"), "fp", F.col("fp").alias("rest")), []
    for level in range(len(WIDTHS)):
        rows = dealt(rows, level)
        if level < len(WIDTHS) - 1:
            hot = cut(rows.groupBy("key").count().where(F.col("count") > shard_rows).select("key"))
            if hot.isEmpty():
                parts.append(rows)
                break
            parts.append(rows.join(hot, "key", "left_anti"))
            rows = cut(rows.join(hot, "key"))
        else:
            parts.append(rows)
    out = [p.select(F.xxhash64("key").alias("key"), "fp").repartition("key").sortWithinPartitions("key").mapInArrow(trees, "a long, b long") for p in parts]
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def components_of(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of prints (doc_id, fp): root is the component's smallest fingerprint."""
    ship(prints.sparkSession)
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = cut(components(links(distinct.select("fp"), radius, shard_rows)))
    linked = labels.join(distinct, labels["node"] == distinct["fp"]).select("node", "root", "least")
    least = cut(linked.groupBy("root").agg(F.min("least").alias("of_group")))
    groups = cut(labels.join(least, "root").select(F.col("node").alias("fp"), "root", "of_group"))
    out = cut(distinct.join(groups, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.least(F.col("least"), F.col("of_group")).alias("component_id")))
    release(distinct, labels, least, groups)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text)."""
    prints = cut(fingerprints(docs))
    groups = components_of(prints, radius, shard_rows)
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one of the smallest doc_id (null ids last), then of the smallest name of
    its text; of rows equal in both, any one. Rows that share a doc_id compete only within a group, and no column of docs is touched."""
    own = lambda id_, tie: F.struct(F.col("doc_id").isNull().alias("nameless"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), id_.alias("id"), tie.alias("tie"))
    id_, tie = text_name(F.coalesce("text", F.lit("")))
    prints = cut(fingerprints(docs, named=True))
    groups = components_of(prints)
    first = prints.groupBy("fp").agg(F.min(own(F.col("id"), F.col("tie"))).alias("key"))  # the rows of a fingerprint shrink before they are shuffled
    keepers = cut(first.join(groups, "fp").groupBy("root").agg(F.min("key").alias("key")).select("key"))
    release(prints, groups)
    rows = docs.select(F.struct("*").alias("row"), own(id_, tie).alias("key")).join(keepers, "key", "left_semi")
    rest = [F.col("row")[c] for c in docs.columns if c not in ("doc_id", "text")]
    one = Window.partitionBy("key").orderBy(F.to_json(F.struct(*rest)) if rest else F.lit(0))
    return rows.withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")
