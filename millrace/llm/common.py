"""What the training-data operators share: tables, names of texts, scratch tables, components."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Rows of a hot key that one part of it has, about.
HOT = 1024
#: Rows of a part of a global order, about, and how many parts there are at most.
SPAN, PARTS = 1 << 14, 10_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let executors import this package where their PYTHONPATH doesn't hold it already.

    Bounds what a Python worker gets at once to 512 rows, as texts may be long; a number that the user has set stays."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, "512")
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    if any(p and Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    target = Path(tempfile.mkdtemp()) / "millrace.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in (root / "millrace").rglob("*.py"):
            z.write(p, p.relative_to(root))
    path = list(sys.path)
    spark.sparkContext.addPyFile(str(target))
    sys.path[:] = path  # the driver keeps its own copy


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session (tests) may leave it unset; a cluster may not."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/millrace-{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor loses none of it.

    ``release`` deletes the table; what results still need goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, store = _path(spark, path)
    store.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            p, store = _path(df.sparkSession, path)
            store.delete(p, True)


def text_name(text: Column) -> tuple[Column, Column]:
    """(long, int): 96 bits of the SHA-256 of a text's UTF-8, the same for equal texts alone."""
    digest = F.sha2(F.encode(text, "UTF-8"), 256)
    bits = lambda at, n: F.conv(F.substring(digest, at, n), 16, -10).cast("long")
    return bits(1, 16), (bits(17, 8) - (1 << 31)).cast("int")


def parts_of(many: Column) -> Column:
    """How many parts a key with many rows is dealt to."""
    return F.greatest(F.lit(1), F.ceil(many / HOT).cast("int"))


def sized(rows: DataFrame, keys: list[str], many: str, of: list[str]) -> DataFrame:
    """The rows whose keys are those of several rows, with their number as ``size``.

    many: a column that bounds a key's rows and is equal for equal keys. A hot key is counted, and told its size, in parts by the columns ``of``: no task gets one whole,
    and what is told has a row for each key and part that occur, so it never outgrows the rows."""
    parted = rows.withColumn("_part", F.pmod(F.xxhash64(*of), parts_of(F.col(many))).cast("int"))
    by_part = parted.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("n"))
    by_key = by_part.groupBy(*keys).agg(F.sum("n").alias("size")).where("size > 1")
    told = by_part.join(by_key, keys).select(*keys, "_part", "size")
    return parted.join(told, [*keys, "_part"]).drop("_part")


def running(df: DataFrame, order: list[Column], value: Column) -> DataFrame:
    """df, a written table, with ``before``: the sum of value over the rows that come earlier in the order, and ``part``: a part of the order, by number.

    Rows are dealt to ranges of the order; sums of whole ranges (a row for each, ``PARTS`` at most) are added up apart, so no task sees more than a range. Rows that the order
    doesn't tell apart stay in one range: group them first."""
    parts = min(PARTS, max(1, -(-df.count() // SPAN)))
    dealt = cut(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = dealt.groupBy("part").agg(F.sum(value).alias("_sum")).select("part", zero(F.sum("_sum").over(earlier(Window.orderBy("part")))).alias("_from"))
    within = zero(F.sum(value).over(earlier(Window.partitionBy("part").orderBy(*order))))
    out = cut(dealt.select("*", within.alias("_within")).join(F.broadcast(sums), "part").select(*df.columns, "part", (F.col("_from") + F.col("_within")).alias("before")))
    release(dealt)
    return out


def repeated(df: DataFrame, n: str, name: str) -> DataFrame:
    """Every row n times, numbered from 0 in column name; a row of very many is dealt out in parts of ``HOT``."""
    upto = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), last)).alias(name)
    few = df.where(F.col(n) <= HOT).select("*", upto(F.col(n) - 1))
    many = df.where(F.col(n) > HOT).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(HOT).cast("long"))).alias("_from")).repartition("_from")
    many = many.select("*", upto(F.least(F.lit(HOT), F.col(n) - F.col("_from")) - 1).alias("_at")).withColumn(name, F.col("_from") + F.col("_at"))
    return few.unionByName(many.select(*few.columns))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that it reaches.

    Alternates large-star and small-star steps; each is a grouped minimum and an equi-join, so no
    neighbourhood is ever gathered in one place. Rounds grow with the logarithm of the longest chain.
    """
    pair = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = cut(pair(edges)), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, last = state, now
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        mid = cut(pair(large))
        down = cut(mid.groupBy("a").agg(F.min("b").alias("m")))
        small = mid.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = cut(pair(small))
        release(last, least, mid, down)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
