"""Mixing sources to target weights by a splitting tree over blocks, with DataFrame functions only.

Sizes are words. The sources, in code point order with null last, weigh 5, 2, 1 and again; they share the size of all
documents by weight, but none gets more than ``MOST_COPIES`` times its own, and what is over goes to the others.

A source's documents are permuted by a hash of doc_id, whose first bits are the block. Each document is drawn
floor(target / source size) times, and some once more, in rounds: a round goes on through the permutation from where the
one before ended, over the documents that are no larger than what is still missing, and ends at the first that doesn't fit
any more. There are rounds until no document fits (each leaves less missing than the size of the document it ended at); the
document closest to what is missing then goes in if that brings the source nearer. A round is a range of hashes and a size
bound, so documents find their copies by their source's row of the plan.

The hash of doc_id also cuts a source into blocks of about the same number of words, ``BLOCKS_PER_SHARD`` to an output shard.
The drawn copies of the blocks that hold rows are numbered in the order of the permutation; how many a source has is its
quota at the root of the splitting tree. A node draws the quotas of its two children: it puts one token for each block copy of its
quotas into random order and the first half goes left. So the children's quotas are a multivariate hypergeometric draw and sum up to
the node's exactly; a leaf is a shard. A node of at most ``NODE_TOKENS`` tokens is one row, and its whole subtree is split without
moving anything; the nodes above it are split level by level, in ranges of the random order, so no task sees all
tokens. Shards then take the next block copies of each source's permutation, as many as their quota (``quotas``), and a
shard's rows are shuffled by a hash.

Null text: size 0, drawn like the rest; empty tables give no rows. Null sources are one source. Null doc_ids share one block,
in an order of their texts. Rows equal in doc_id and text (ties) share one place in the permutation: they are drawn together or
not at all. A very long document is drawn whole if it fits, and makes its block larger. Reruns agree. Extra columns pass through
``mix`` whatever their names; one named shard is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import discard, materialise

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
HASH_BITS, TEXT_BITS, STEP_BITS, STEP_LEVELS = 63, 24, 10, 2
WORDS_PER_SHARD, BLOCKS_PER_SHARD, LEAST_SHARDS = 1 << 22, 16, 16
NODE_TOKENS, RANGE_BITS = 1 << 14, 10
END = (1 << 63) - 1
WORD = r"[^\x20\x09-\x0D]+"
SEED = 20240


def is_small(df: DataFrame, rows: int = 100_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def bounded(small: DataFrame, rows: int = 100_000) -> DataFrame:
    """``small`` to be broadcast if it has at most so many rows, else as it is: Spark then shuffles and splits hot keys."""
    return F.broadcast(small) if is_small(small, rows) else small


def size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size`` (words) and ``place`` (63 bits: a hash of doc_id, the last ``TEXT_BITS`` of the text with it)."""
    return docs.withColumn("size", size()).withColumn("place", place())


def place() -> Column:
    of_id = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(SEED)), 1 + TEXT_BITS)
    return F.shiftleft(of_id, TEXT_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(SEED)), 64 - TEXT_BITS))


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``sizes (source, size)``."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1)
    most = MOST_COPIES * F.col("source_size")
    w = by_source.withColumn("weight", weight).withColumn("most", most)
    # in order of most / weight, the sources that stop at their most come first
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = w.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("given"),
        F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("waiting"),
    )
    w = w.withColumn("stops", F.col("most") * F.col("waiting") <= F.col("weight") * (F.col("total") - F.col("given")))
    free = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything)
    rest = F.col("total") - F.sum(F.when(F.col("stops"), F.col("most")).otherwise(0)).over(everything)
    share = F.col("weight") * rest / free
    return w.select("source", "source_size", F.when(F.col("stops"), F.col("most").cast("double")).otherwise(share).alias("target"))


def plan(rows: DataFrame) -> DataFrame:
    """``source, source_size, target, copies, rounds, last``: a row for each source.

    ``rows``: ``doc_id, source, size, place``. Documents are drawn ``copies`` times, and once more (``extra``) if a round
    has them or they are at the place ``last``.
    """
    goal = targets(rows).withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.lit(MOST_COPIES), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int"))
    goal = goal.withColumn("gap", F.when(F.col("copies") < MOST_COPIES, F.col("target") - F.col("copies") * F.col("source_size")).otherwise(0.0))
    found = materialise(goal.withColumn("low", F.lit(0).cast("long")).withColumn("rounds", F.array().cast("array<struct<low: bigint, cut: bigint, bound: double>>")).withColumn("open", F.col("gap") > 0))
    few = is_small(found)
    while not found.where("open").isEmpty():
        last, found = found, materialise(next_round(rows, found, few))
        discard(last)
    # every document that is left is larger than what is missing: the closest, with those at its place
    left = of_sources(rows, found.where("gap > 0"), few, "gap", "rounds").where((F.col("size") > F.col("gap")) & (F.col("size") < 2 * F.col("gap")) & ~in_rounds())
    places = left.groupBy("source", "place", "gap").agg(F.sum("size").alias("size")).where("size < 2 * gap")
    last = places.groupBy("source").agg(F.min(F.struct("size", "place"))["place"].alias("last"))
    return found.join(last.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "copies", "rounds", "last")


def first_beyond(rows: DataFrame) -> DataFrame:
    """``source, unit, room, all`` from ``source, unit, size, room``: the first unit up to which a source has more than its room.

    ``room`` is what is left of it before that unit, ``all`` the size of all its units.
    """
    sums = rows.groupBy("source", "room", "unit").agg(F.sum("size").alias("size"))
    sums = sums.withColumn("end", F.sum("size").over(Window.partitionBy("source").orderBy("unit")))
    first = F.min(F.when(F.col("end") > F.col("room"), F.struct("unit", (F.col("room") - F.col("end") + F.col("size")).alias("room"))))
    return sums.groupBy("source").agg(first.alias("f"), F.max("end").alias("all")).select("source", "f.unit", "f.room", "all")


def next_round(rows: DataFrame, found: DataFrame, few: bool) -> DataFrame:
    """``found`` after one more round of each source that is ``open``; those without a document that fits aren't any more."""
    going = found.where("open")
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("gap")) & (F.col("place") >= F.col("low"))
    fit = of_sources(rows, going, few, "gap", "low").where(fits).select("source", "place", "size", F.col("gap").alias("room"))
    unit = lambda level: F.shiftright("place", HASH_BITS - level * STEP_BITS)
    # the permutation in 2 ** STEP_BITS steps, the step that the gap ends in by as many, then the places in that
    whole = reached = materialise(first_beyond(fit.withColumn("unit", unit(1))))
    for level in range(1, STEP_LEVELS):
        inside = of_sources(fit.drop("room"), reached.where("unit is not null"), few, "unit", "room").where(unit(level) == F.col("unit"))
        reached = materialise(first_beyond(inside.withColumn("unit", unit(level + 1))))
    inside = of_sources(fit.drop("room"), reached.where("unit is not null"), few, "unit", "room").where(unit(STEP_LEVELS) == F.col("unit"))
    cut = first_beyond(inside.withColumn("unit", F.col("place"))).where("unit is not null").select("source", F.struct(F.col("unit").alias("place"), F.col("room").alias("gap")).alias("cut"))
    key = lambda df: F.col("source").eqNullSafe(df["s"])
    whole, cut = whole.select(F.col("source").alias("s"), "all"), cut.select(F.col("source").alias("s"), "cut")
    after = found.join(whole, key(whole), "left").drop("s").join(cut, key(cut), "left").drop("s")
    # the place that the round ended at fits no more, whatever its row sizes: go on behind it
    end, gap = F.coalesce("cut.place", F.lit(END)), F.coalesce("cut.gap", F.col("gap") - F.col("all"))
    drew = F.col("all").isNotNull()
    return after.select(
        "source",
        "source_size",
        "target",
        "copies",
        F.when(drew, gap).otherwise(F.col("gap")).alias("gap"),
        F.when(drew & (end < END), end + 1).otherwise(F.col("low")).alias("low"),
        F.when(drew, F.concat("rounds", F.array(F.struct("low", end.alias("cut"), F.col("gap").alias("bound"))))).otherwise(F.col("rounds")).alias("rounds"),
        (drew & F.col("cut").isNotNull() & (gap > 0)).alias("open"),
    )


def of_sources(rows: DataFrame, by_source: DataFrame, few: bool, *columns: str) -> DataFrame:
    """``rows`` of the sources in ``by_source``, with its ``columns``; ``few`` sources are broadcast."""
    small = by_source.select(F.col("source").alias("__s"), *columns)
    return rows.join(F.broadcast(small) if few else small, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def in_rounds() -> Column:
    return F.exists("rounds", lambda r: (F.col("place") >= r["low"]) & (F.col("place") < r["cut"]) & (F.col("size") <= r["bound"]))


def extra() -> Column:
    """Whether a document is drawn once more than ``copies`` says."""
    return in_rounds() | F.coalesce(F.col("place") == F.col("last"), F.lit(False))


def with_blocks(plan_: DataFrame, shards: int) -> DataFrame:
    """``plan_`` with ``blocks``: how many each source is cut into."""
    total = plan_.agg(F.sum("target")).first()[0] or 1.0
    return plan_.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") * (shards * BLOCKS_PER_SHARD / total))).cast("long"))


def block() -> Column:
    """The block of a place, from 0."""
    return F.shiftright(F.shiftright("place", 32) * F.col("blocks"), HASH_BITS - 32)


def with_plan(rows: DataFrame, plan_: DataFrame) -> DataFrame:
    """``rows`` with their source's row of the plan, their ``block`` and whether they are drawn once more (``more``)."""
    joined = rows.join(bounded(plan_.withColumnRenamed("source", "__s")), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    return joined.withColumn("block", block()).withColumn("more", extra()).drop("rounds", "last", "blocks")


def numbered(planned: DataFrame) -> DataFrame:
    """``source, block, copies, whole, extra, at, extra_at``: the blocks that hold rows, numbered in the order of the permutation.

    A source's block copies are ``copies`` times its ``whole`` blocks, and then its ``extra`` ones, which hold rows that are drawn once
    more; ``at`` and ``extra_at`` (null without such rows) count from 0. Numbers are carried on over ranges of blocks.
    """
    blocks = planned.groupBy("source", "block").agg(F.first("copies").alias("copies"), F.bool_or("more").cast("int").alias("has")).withColumn("range", F.shiftright("block", RANGE_BITS))
    ranges = blocks.groupBy("source", "range").agg(F.count("*").alias("n"), F.sum("has").alias("h"))
    all_of, before = Window.partitionBy("source"), Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    prior = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    ranges = ranges.select(F.col("source").alias("__s"), F.col("range").alias("__r"), prior("n").alias("n0"), prior("h").alias("h0"), F.sum("n").over(all_of).alias("whole"), F.sum("h").over(all_of).alias("extra"))
    own = Window.partitionBy("source", "range").orderBy("block")
    joined = blocks.join(ranges, F.col("source").eqNullSafe(F.col("__s")) & (F.col("range") == F.col("__r")))
    at, extra_at = F.col("n0") + F.row_number().over(own) - 1, F.col("h0") + F.sum("has").over(own) - 1
    return joined.select("source", "block", "copies", "whole", "extra", at.alias("at"), F.when(F.col("has") > 0, extra_at).alias("extra_at"))


def token_key(level: int, source: Column, number: Column) -> Column:
    """The place of a token in the random order of a node of ``level``."""
    return F.xxhash64(F.lit(SEED + 1 + level), source, number)


def left_part(total: Column, level: int) -> Column:
    """How many tokens of a node go left: half of them, the odd one left and right by turns of the level."""
    return F.shiftright(total + level % 2, 1)


def split_rows(tokens: DataFrame, level: int) -> DataFrame:
    """``node, source, number`` a level down: ranges of each node's random order are counted, then ordered by themselves."""
    keyed = tokens.withColumn("key", token_key(level, F.col("source"), F.col("number"))).withColumn("range", F.shiftright("key", 64 - RANGE_BITS))
    ranges = keyed.groupBy("node", "range").agg(F.count("*").alias("n"))
    node = Window.partitionBy("node")
    before = F.coalesce(F.sum("n").over(node.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("node", "range", before.alias("before"), F.sum("n").over(node).alias("total"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("node", "range").orderBy("key", "source", "number"))
    right = (rank > left_part(F.col("total"), level)).cast("int")
    return keyed.join(ranges, ["node", "range"]).select((2 * F.col("node") + right).alias("node"), "source", "number")


def split_arrays(nodes: DataFrame, level: int) -> DataFrame:
    """``node, tokens`` a level down, for nodes that are one row each."""
    ordered = F.array_sort(F.transform("tokens", lambda t: F.struct(token_key(level, t["source"], t["number"]).alias("key"), t["source"].alias("source"), t["number"].alias("number"))))
    keyed = nodes.select("node", F.transform(ordered, lambda t: F.struct(t["source"], t["number"])).alias("t"))
    left = left_part(F.size("t"), level)
    both = F.array(F.struct((2 * F.col("node")).alias("node"), F.slice("t", F.lit(1), left).alias("tokens")), F.struct((2 * F.col("node") + 1).alias("node"), F.slice("t", left + 1, F.size("t")).alias("tokens")))
    return keyed.select(F.explode(both).alias("c")).select("c.*")


def quotas(totals: DataFrame, shards: int) -> DataFrame:
    """``shard, source, quota``: the leaves of the splitting tree over ``totals (source, n)``. ``shards``: a power of two."""
    levels = (shards - 1).bit_length()
    size = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens = totals.where("n > 0").select(F.lit(0).cast("long").alias("node"), "source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("number"))
    level = 0
    while level < levels and size > NODE_TOKENS:
        tokens, size, last = materialise(split_rows(tokens, level)), -(-size // 2), tokens if level else None
        if last is not None:
            discard(last)
        level += 1
    if level < levels:
        nodes = tokens.groupBy("node").agg(F.collect_list(F.struct("source", "number")).alias("tokens"))
        for at in range(level, levels):
            nodes = split_arrays(nodes, at)
        tokens = nodes.select("node", F.explode("tokens").alias("t")).select("node", "t.source")
    return tokens.groupBy(F.col("node").cast("int").alias("shard"), "source").agg(F.count("*").alias("quota"))


def dealt(blocks: DataFrame, leaves: DataFrame) -> DataFrame:
    """``source, block, copy, shard`` from ``numbered`` and ``quotas``: each shard takes the next block copies of each source."""
    end = F.sum("quota").over(Window.partitionBy("source").orderBy("shard"))  # a row for each shard of a source
    places = leaves.withColumn("end", end).select(F.col("source").alias("__s"), "shard", F.explode(F.sequence(F.col("end") - F.col("quota"), F.col("end") - 1)).alias("__p"))
    one = lambda copy, place: F.struct(copy.alias("copy"), place.alias("place"))
    none = F.array().cast("array<struct<copy:int,place:bigint>>")
    whole = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(1), F.col("copies")), lambda k: one(k, (k - 1) * F.col("whole") + F.col("at")))).otherwise(none)
    rest = F.when(F.col("extra_at").isNotNull(), F.array(one(F.col("copies") + 1, F.col("copies") * F.col("whole") + F.col("extra_at")))).otherwise(none)
    copies = blocks.select("source", "block", F.explode(F.concat(whole, rest)).alias("c")).select("source", "block", "c.*")
    return copies.join(places, F.col("source").eqNullSafe(F.col("__s")) & (F.col("place") == F.col("__p"))).select("source", "block", "copy", "shard")


def shard_count(words: float) -> int:
    """The least power of two with at most ``WORDS_PER_SHARD`` words a shard, ``LEAST_SHARDS`` at least."""
    return max(LEAST_SHARDS, 1 << max(0, -(-int(words) // WORDS_PER_SHARD) - 1).bit_length())


def draws(rows: DataFrame, shards: int | None = None) -> DataFrame:
    """``rows (doc_id, source, size, place, ...)`` with ``source_size, target, copies, shards`` (one for each copy)."""
    return _draws(rows, shards)[0]


def _draws(rows: DataFrame, shards: int | None, small: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``draws`` and the number of shards. ``small``: a table of the rows' ``doc_id, source, size, place``, if there is one."""
    small = materialise(rows.select("doc_id", "source", "size", "place")) if small is None else small
    p = materialise(plan(small))
    shards = shards or shard_count(p.agg(F.sum("target")).first()[0] or 0)
    p = materialise(with_blocks(p, shards))
    blocks = materialise(numbered(with_plan(small, p)))
    totals = blocks.groupBy("source").agg(F.first(F.col("copies") * F.col("whole") + F.col("extra")).alias("n"))
    nodes = dealt(blocks, quotas(totals, shards))
    of_blocks = nodes.groupBy("source", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda s: s["shard"]).alias("dealt"))
    of_blocks = materialise(of_blocks.select(F.col("source").alias("__s"), F.col("block").alias("__b"), "dealt"))
    joined = with_plan(rows, p).join(bounded(of_blocks), F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")), "left")
    copies = F.col("copies") + F.col("more").cast("int")
    return joined.withColumn("shards", F.when(F.col("dealt").isNull(), F.array().cast("array<int>")).otherwise(F.slice("dealt", F.lit(1), copies))).withColumn("copies", copies).drop("__s", "__b", "block", "more", "dealt"), shards


def mix(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The mix: the rows of ``docs``, each as often as it is drawn, with ``shard``; a shard is a partition, in random order.

    ``shards``: a power of two, by default so many that a shard has ``WORDS_PER_SHARD`` words at most, about.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "shard"))
    drawn, shards = _draws(docs.select("doc_id", "source", size().alias("size"), place().alias("place"), row.alias("row")), shards)
    rows = drawn.select("doc_id", "row", F.posexplode("shards").alias("copy", "shard"))
    ordered = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.xxhash64("doc_id", "copy", F.lit(SEED + 99)))
    return ordered.select("row.*", "shard")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    rows = materialise(sized(docs).select("doc_id", "source", "size", "place"))
    drawn = _draws(rows, None, rows)[0]
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")
