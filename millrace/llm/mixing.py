"""Mixing sources to target weights: blocks of words, multinomial draws for each shard, pseudorandom permutations of block numbers.

Targets. A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``. Sources, by code point and null last, have the weights ``WEIGHTS`` in turn and share ``SHARE`` times all words; a target stops at
``MOST`` times its source's words, and the excess is shared again by weight until none is above.

Blocks. A source's documents, in the order of an MD5 of their doc_id, are one line of words, cut into blocks of ``BLOCK`` words (the last one may be shorter). A block is known by its source and number; where each
document begins in its line comes from sums over ranges of the order (``running``), so no source is gathered anywhere.

Draws. The mix is a row of slots, ``SLOTS`` to a shard, each of a block. Every slot draws its source with the probabilities of the targets, which gives each shard multinomial counts of sources. Slots are then numbered within
their sources; those beyond a source's quota, as chance will have it (about a root of the slots), go to the sources that chance left short. A source's slot number, modulo its blocks, goes through a permutation of
the block numbers, another one for each round through the source (swap-or-not with ``ROUNDS`` rounds, a permutation of any range), and slots meet the words by a join on source and block.
A source's last slots are shortened, so it gives its target, rounded, exactly. Each block is used ``MOST`` times at most, hence so is each word of a document.

Everything is DataFrame functions. All randomness is MD5 of a seed and of numbers that the rows define, so reruns agree, whatever the partitions.

Nulls: a null text has size 0, a null source is a source of its own, the last; a null doc_id is kept as null. Repeated rows stay repeated: those alike in doc_id, source and text are counted together and told apart by their copy's number;
which of them has which part of the line makes no difference to their rows. Empty texts take part with size 0 and nothing taken. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release, repeated, running

WEIGHTS, SHARE, MOST, BLOCK, SLOTS, ROUNDS, SEED = (3, 1, 2), 1.5, 2, 128, 1024, 12, 42
#: Last slots of a source that may be shortened, and slots that it has beyond those that it needs on average, as its shorter block may come early.
TAIL, MORE = 16, 4
#: Numbers to a bin, at least, where numbers look up the range that holds them, and bins at most.
BIN, BINS = 1024, 1 << 20


def size_of(text: Column) -> Column:
    """Words of a text, by making each of them one character."""
    marks = F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def _md5(seed: int, *of: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in of]))


def number(seed: int, *of: Column) -> Column:
    """60 pseudorandom bits."""
    return F.conv(F.substring(_md5(seed, *of), 1, 15), 16, 10).cast("long")


def shuffled(x: Column, k: Column, seed: int, *key: Column) -> Column:
    """x's place in a permutation of 0 .. k - 1: in each round x and (round's number - x) mod k change places or don't, by a bit that both share."""
    def step(a: Column, r: Column) -> Column:
        other = F.pmod(number(seed, F.lit("turn"), *key, r) - a, k)
        return F.when(_md5(seed, F.lit("swap"), *key, r, F.greatest(a, other)) >= "8", other).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)


def ranged(points: DataFrame, at: str, ranges: DataFrame, total: int) -> DataFrame:
    """points with the columns of the range [low, high) that holds ``at``; ranges don't overlap and lie within 0 .. total. Both meet by bins, so neither is broadcast by force."""
    width = max(BIN, -(-total // BINS))
    bins = F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}")))
    dealt = ranges.where("high > low").select("*", bins.alias("_bin"))
    return points.withColumn("_bin", F.expr(f"{at} div {width}")).join(dealt, "_bin").where((F.col(at) >= F.col("low")) & (F.col(at) < F.col("high"))).drop("_bin", "low", "high")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources (no, source_size) with ``target``. Rounds end when no further source reaches its bound."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    bound, rate, met = most * F.col("source_size"), 0.0, -1
    whole = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        above = weight * rate > bound
        full, free, n = sources.agg(F.coalesce(F.sum(F.when(above, bound)), F.lit(0)), F.coalesce(F.sum(F.when(~above, weight)), F.lit(0.0)), F.count_if(above)).first()
        if n == met or not free:
            return sources.withColumn("target", F.least(weight * rate, bound.cast("double")))
        met, rate = n, (whole - full) / free


def lines(docs: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): the documents with their place in the line of their source, copies counted in n; and sources (source, no, source_size)."""
    of = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))
    kinds = cut(of.groupBy("doc_id", "source", "size", "mark").agg(F.count(F.lit(1)).alias("n")).withColumn("turn", number(seed, F.lit("line"), F.col("doc_id"))))
    words = F.col("n") * F.col("size")
    placed = running(kinds, [F.col("source").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("turn", "doc_id", "size", "mark")]], words)
    release(kinds)
    parts = cut(placed.groupBy("source", "part").agg(F.sum(words).alias("words"), F.min("before").alias("first")))
    sums = cut(parts.groupBy("source").agg(F.sum("words").alias("source_size"), F.min("first").alias("first")))
    sources = running(sums, [F.col("source").asc_nulls_last()], F.lit(1)).drop("part").withColumnRenamed("before", "no")
    told = parts.select("source", "part").join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source_size")
    told = told.select(F.col("source").alias("_s"), F.col("part").alias("_p"), "no", F.col("first"))  # a hot source has many parts, none of them large
    rows = placed.join(told, (F.col("part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    rows = cut(rows.select("doc_id", "source", "no", "size", "mark", "n", (F.col("before") - F.col("first")).alias("start"), "part"))
    release(placed, parts, sums)
    return rows, sources.drop("first")


def slots(sources: DataFrame, block: int = BLOCK, slots_: int = SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, slot, no, block, take) of sources (no, source_size, target): which block each slot of the mix takes, and how many of its words."""
    spark = sources.sparkSession
    each = sources.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    mean = F.col("source_size") / F.col("blocks")
    quota = F.when(F.col("target") > 0, F.least(MOST * F.col("blocks"), F.floor(F.col("target") / mean) + MORE)).otherwise(F.lit(0)).cast("long")
    each = cut(each.select("no", "source_size", "blocks", F.floor(F.col("target") + 0.5).cast("long").alias("words"), quota.alias("quota")))
    total = each.agg(F.sum("quota")).first()[0] or 0
    low = running(each, [F.col("no")], F.col("quota"))
    ranges = low.select("no", F.col("before").alias("low"), (F.col("before") + F.col("quota")).alias("high"))
    draws = spark.range(total).select(F.expr(f"id div {slots_}").alias("shard"), F.col("id").alias("slot"), (number(seed, F.lit("draw"), F.col("id")) % max(1, total)).alias("v"))
    drawn = cut(ranged(draws, "v", ranges, total).select("shard", "slot", "no"))
    counts = cut(drawn.groupBy("no", "shard").agg(F.count(F.lit(1)).alias("n")))  # a multinomial row of counts for each shard
    upto = running(counts, [F.col("no"), F.col("shard")], F.col("n"))
    per = upto.groupBy("no").agg(F.min("before").alias("first"), F.sum("n").alias("drawn"))
    known = cut(each.join(per, "no", "left").select("*", F.coalesce("drawn", F.lit(0)).alias("got")).drop("drawn"))
    over = running(known, [F.col("no")], F.greatest(F.lit(0), F.col("got") - F.col("quota")))
    short = running(known, [F.col("no")], F.greatest(F.lit(0), F.col("quota") - F.col("got")))
    facts = ["source_size", "blocks", "words", "quota"]
    told = upto.join(over.select("no", "first", F.col("before").alias("spare"), *facts), "no").select("no", "shard", (F.col("before") - F.col("first")).alias("from"), "spare", *facts)
    rank = F.row_number().over(Window.partitionBy("no", "shard").orderBy("slot")) - 1  # within a shard, so bounded
    numbered = cut(drawn.join(told, ["no", "shard"]).select("*", (F.col("from") + rank).alias("i")).drop("from"))
    gaps = short.select("no", *facts, "got", "before", F.col("before").alias("low"), (F.col("before") + F.col("quota") - F.col("got")).alias("high"))
    spare = numbered.where("i >= quota").select("shard", "slot", (F.col("spare") + F.col("i") - F.col("quota")).alias("j"))
    moved = ranged(spare, "j", gaps, total).select("shard", "slot", "no", *facts, (F.col("got") + F.col("j") - F.col("before")).alias("i"))
    whole = numbered.where("i < quota").select(*moved.columns).unionByName(moved)
    at = shuffled(F.col("i") % F.col("blocks"), F.col("blocks"), seed, F.col("no"), F.expr("i div blocks"))
    whole = whole.withColumn("block", at).withColumn("take", F.least(F.lit(block), F.col("source_size") - F.col("block") * block))
    whole = cut(whole.select("shard", "slot", "no", "i", "quota", "words", "block", "take"))
    release(each, low, drawn, counts, upto, known, over, short, numbered)
    last = F.col("i") >= F.col("quota") - TAIL
    sums = whole.where(~last).groupBy("no").agg(F.sum("take").alias("_sum"))
    earlier = F.coalesce(F.sum("take").over(Window.partitionBy("no").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # TAIL rows
    tail = whole.where(last).withColumn("_earlier", earlier).join(sums, "no", "left")
    left = F.col("words") - F.coalesce("_sum", F.lit(0)) - F.col("_earlier")
    tail = tail.withColumn("take", F.least(F.col("take"), left)).where("take > 0")
    names = ["shard", "slot", "no", "block", "take"]
    return whole.where(~last).select(*names).unionByName(tail.select(*names))


def pieces(rows: DataFrame, chosen: DataFrame, block: int = BLOCK) -> DataFrame:
    """(shard, slot, at, no, row, doc_id, word, length) of the mix: from word ``word`` on, ``length`` words of a document stand at ``at`` of a slot. (no, row) names a row of ``copies``."""
    reach = F.explode(F.sequence(F.expr(f"row div {block}"), F.expr(f"(row + size - 1) div {block}")))
    spans = rows.select("no", "row", "doc_id", "size", reach.alias("block"))
    begin = F.col("block") * block
    spans = spans.select("no", "block", "row", "doc_id", F.greatest("row", begin).alias("low"), F.least(F.col("row") + F.col("size"), begin + block).alias("high"))
    met = spans.join(chosen, ["no", "block"])
    length = F.least(F.col("high"), begin + F.col("take")) - F.col("low")
    return met.select("shard", "slot", (F.col("low") - begin).alias("at"), "no", "row", "doc_id", (F.col("low") - F.col("row")).alias("word"), length.alias("length")).where("length > 0")


def copies(rows: DataFrame) -> DataFrame:
    """rows with one row for each copy, and ``row``: where it begins in its source's line."""
    return repeated(rows, "n", "copy").withColumn("row", F.col("start") + F.col("copy") * F.col("size"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The pieces of the mix of docs (doc_id, source, text), slot by slot."""
    rows, sources = lines(docs, seed)
    chosen = cut(slots(targets(sources, weights, share), block, seed=seed))
    return pieces(copies(rows.where("size > 0")), chosen, block)


def taken(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs (doc_id, source, text), from the pieces of the mix."""
    rows, sources = lines(docs, seed)
    aimed = targets(sources, weights, share)
    chosen = cut(slots(aimed, block, seed=seed))
    each = copies(rows)
    parts = rows.select("no", "part").distinct().join(aimed.select("no", "source_size", "target"), "no")  # a hot source's rows meet its figures part by part
    sums = pieces(each.where("size > 0"), chosen, block).groupBy("no", "row").agg(F.sum("length").alias("taken"))
    full = each.where("size > 0").join(sums, ["no", "row"], "left")
    names = ["doc_id", "no", "part", "size", "taken"]
    both = full.select(*names).unionByName(each.where("size = 0").withColumn("taken", F.lit(None).cast("long")).select(*names))
    return both.join(parts, ["no", "part"]).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
