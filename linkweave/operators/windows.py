"""Windows, sorts, pages and set operations. Strings sort by bytes (SRT-5), which is Spark's default collation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """WIN-1: the first row of each key in input order."""
    keys, orders = ([x] if isinstance(x, str) else list(x) for x in (key, order))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*orders))).where("_n = 1").drop("_n")


#: Arrivals whose numbers differ in the lowest bits alone are one range: what a task sees of a key at once.
RANGE_BITS = 16


def arrival_range(order: str = "seq") -> Column:
    """The range of a number of arrival; it is in order like the number itself."""
    return F.shiftright(order, RANGE_BITS)


def earlier_max(rows: DataFrame, keys: Sequence[str], order: str, moment: str, name: str, known: DataFrame | None = None, range_: Column | None = None) -> DataFrame:
    """``rows`` with ``name``: the largest ``moment`` of their key's earlier rows; and with ``_range``.

    A segmented scan, so that a key with very many rows is many tasks' work: the largest of each (key, range) is aggregated, a scan
    over a key's few ranges carries them on, and each (key, range) is scanned by itself from there. ``known``:
    ``keys`` and ``_known``, what came before all rows. ``range_`` has to be in order like ``order``; keys aren't null.
    """
    rows = rows.withColumn("_range", arrival_range(order) if range_ is None else range_)
    ranges = rows.groupBy(*keys, "_range").agg(F.max(moment).alias("_m"))
    before = F.max("_m").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(*keys, "_range", before.alias("_before"))
    if known is not None:
        ranges = ranges.join(known, list(keys), "left").withColumn("_before", F.greatest("_before", "_known")).drop("_known")
    own = F.max(moment).over(Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(ranges, [*keys, "_range"], "left").withColumn(name, F.greatest(own, "_before")).drop("_before")


def not_late(rows: DataFrame, key: str, order: str, moment: str, known: Column | None = None, range_: Column | None = None) -> DataFrame:
    """WIN-2: rows not older than anything of their key that came before, nor than ``known``. Ties stay."""
    out = earlier_max(rows, [key], order, moment, "_bar", None, range_)
    bar = F.col("_bar") if known is None else F.greatest("_bar", known)
    return out.where(bar.isNull() | (F.col(moment) >= bar)).select(*rows.columns)


def failure_run(rows: DataFrame, key: str, order: str, success: str, range_: Column | None = None) -> DataFrame:
    """WIN-3: ``key, failures, any_success``: failures since the last success.

    Counted in each (key, range) after its own last success, then summed over the ranges from the last that has one.
    """
    rows = rows.withColumn("_range", arrival_range(order) if range_ is None else range_)
    last = F.max(F.when(F.col(success), F.col(order))).over(Window.partitionBy(key, "_range"))
    ranges = rows.withColumn("_last", last).groupBy(key, "_range").agg(
        F.count_if(~F.col(success) & (F.col("_last").isNull() | (F.col(order) > F.col("_last")))).alias("_n"), F.coalesce(F.bool_or(success), F.lit(False)).alias("_any")
    )
    ranges = ranges.withColumn("_from", F.max(F.when(F.col("_any"), F.col("_range"))).over(Window.partitionBy(key)))
    since = F.col("_from").isNull() | (F.col("_range") >= F.col("_from"))
    return ranges.groupBy(key).agg(F.sum(F.when(since, F.col("_n")).otherwise(0)).alias("failures"), F.bool_or("_any").alias("any_success"))


def newest_first(posts: DataFrame) -> DataFrame:
    """SRT-1: ties by unique_id, as there is no surrogate key."""
    return posts.orderBy(F.desc("posted_at"), F.desc("unique_id"))


def catalog_order(catalog: DataFrame, name: str) -> DataFrame:
    """SRT-2, SRT-3: enabled first, removed last, then by name."""
    return catalog.orderBy(F.desc("enabled"), F.col("deleted_at").isNotNull(), name)


def follows_order(follows: DataFrame, *names: str) -> DataFrame:
    """SRT-4: without regard to case."""
    return follows.orderBy(*(F.lower(n) for n in names))


def page(rows: DataFrame, number: int, size: int, *order) -> DataFrame:
    """LIM-1: one page of the ordered rows. Deep pages cost all rows before them; ``page_after`` and ``directory_page`` don't."""
    if number < 1 or size < 1:
        raise ValueError("page and size start at 1")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(posts: DataFrame, size: int, posted_at, unique_id: str) -> DataFrame:
    """The page after a known last post, by key range."""
    after = (F.col("posted_at") < F.lit(posted_at)) | ((F.col("posted_at") == F.lit(posted_at)) & (F.col("unique_id") < unique_id))
    return newest_first(posts.where(after)).limit(size)


def page_directory(posts: DataFrame, ranges: int) -> DataFrame:
    """LIM-1: ``newest, oldest, rows, before``: of each range of posts, newest first, its ends, its size and the rows before it.

    ``newest`` and ``oldest`` are structs of ``posted_at`` and ``unique_id``, neither of which is null. The two columns are dealt to
    about ``ranges`` ranges of equal size by one shuffle (equal times are told apart by unique_id, so no instant is too large for a range);
    what comes out has a row a range. It holds for the posts it was made of: write it beside each version of them.
    """
    keys = posts.select("posted_at", "unique_id").repartitionByRange(ranges, F.desc("posted_at"), F.desc("unique_id"))
    key = F.struct("posted_at", "unique_id")
    each = keys.select(F.spark_partition_id().alias("part"), key.alias("key")).groupBy("part")
    each = each.agg(F.max("key").alias("newest"), F.min("key").alias("oldest"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    return each.select("newest", "oldest", "rows", F.coalesce(before, F.lit(0)).alias("before"))


def directory_page(posts: DataFrame, directory: DataFrame, number: int, size: int) -> DataFrame:
    """LIM-1: the same page as ``page`` newest first, however deep, read from the ranges that it lies in; none past the end.

    At most ``size`` rows of the directory are fetched; their ends reach the scan as bounds of ``posted_at``.
    """
    if number < 1 or size < 1:
        raise ValueError("page and size start at 1")
    start = (number - 1) * size
    found = directory.where((F.col("before") + F.col("rows") > start) & (F.col("before") < start + size)).orderBy("before").collect()
    if not found:
        return posts.limit(0)
    (newest_at, newest_id), (oldest_at, oldest_id) = found[0]["newest"], found[-1]["oldest"]
    at, own = F.col("posted_at"), F.col("unique_id")
    inside = (at < F.lit(newest_at)) | (own <= F.lit(newest_id))
    inside = at.between(F.lit(oldest_at), F.lit(newest_at)) & inside & ((at > F.lit(oldest_at)) | (own >= F.lit(oldest_id)))
    return newest_first(posts.where(inside)).offset(start - found[0]["before"]).limit(size)


def clamped_page(number: int, total: int, size: int) -> int:
    """LIM-2: between 1 and the last page."""
    return max(1, min(number, -(-total // size)))


def limited(rows: DataFrame, limit: int | None) -> DataFrame:
    """LIM-3."""
    if limit is not None and limit < 0:
        raise ValueError("a limit can't be negative")
    return rows if limit is None else rows.limit(limit)


def union_results(posts: Sequence[DataFrame]) -> DataFrame:
    """SET-1: the records of several sources as one cycle."""
    out = posts[0]
    for p in posts[1:]:
        out = out.unionByName(p)
    return out


def last_snapshots(claims: DataFrame) -> DataFrame:
    """SET-1: of each (source_type, scope) the snapshot that was added last (``seq``)."""
    return claims.groupBy("source_type", "scope").agg(F.max_by(F.struct(*(c for c in claims.columns if c not in ("source_type", "scope"))), "seq").alias("s")).select("source_type", "scope", "s.*")


def file_differences(declared: DataFrame, present: DataFrame) -> DataFrame:
    """SET-3: ``batch_id, name, problem`` of files that only one side has."""
    both = declared.select("batch_id", "name", F.lit(1).alias("d")).join(present.select("batch_id", "name", F.lit(1).alias("p")), ["batch_id", "name"], "full")
    return both.where("d is null or p is null").select("batch_id", "name", F.when(F.col("p").isNull(), "missing").otherwise("undeclared").alias("problem"))


def retain_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """SET-4: rows whose key is still in the catalog."""
    return rows.join(keys.select(key), key, "left_semi")
