"""Vector tables: valid rows, and shards of bounded size as rows of packed arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOB = "part long, dim int, n int, ids binary, vectors binary"


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id long, v array<double>) of rows that take part: an id, and a vector of finite components."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def blobs(rows: DataFrame, by: list[str], make=lambda x: x, keep: list[str] = []) -> DataFrame:
    """A row (part, dim, n, ids, vectors) for each group of rows (vec_id, v, part and dim in by): ids ascend,
    repeated rows count once. keep: long columns of by that the row has too. Groups must be of bounded size."""

    def pack(t: pa.Table) -> pa.Table:
        ids, x = t["vec_id"].to_numpy(), make(matrix(t["v"]))
        order = np.lexsort([*x.T[::-1], ids])
        ids, x = ids[order], x[order]
        if len(ids) > 1:
            new = np.append(True, (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1))
            ids, x = ids[new], x[new]
        return pa.table({"part": [t["part"][0].as_py()], "dim": pa.array([x.shape[1]], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "vectors": pa.array([np.ascontiguousarray(x, np.float64).tobytes()], pa.binary()), **{c: t[c][:1] for c in keep}})

    return rows.groupBy(*by).applyInArrow(pack, BLOB + "".join(f", {c} long" for c in keep))


def sample_of(rows: DataFrame, values: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{dim: (ids, vectors)} of distinct vec_ids of small hash, about ``values`` numbers in all, of rows (vec_id, v, dim)."""
    n, mean = rows.agg(F.count(F.lit(1)), F.avg("dim")).first()
    if not n:
        return {}
    share = min(1.0, values / mean / n)
    low = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1
    t = (rows.where(low) if share < 1 else rows).dropDuplicates(["vec_id"]).select("vec_id", "v", "dim").toArrow()
    t = t.take(np.argsort(t["vec_id"].to_numpy(), kind="stable"))
    dims = t["dim"].to_numpy()
    of = ((int(d), t if (dims == d).all() else t.filter(pa.array(dims == d))) for d in np.unique(dims))
    return {d: (own["vec_id"].to_numpy(), matrix(own["v"])) for d, own in of}


def unpack(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query, ties to the smaller vec_id."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
