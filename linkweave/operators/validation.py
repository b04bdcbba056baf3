"""Validation: rule columns that end in ``errors``, an array of the rules a row breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.times import BATCH_ID, contract_timestamp

WEB = "^https?://"


def errors(rules: dict[str, Column]) -> Column:
    """The names of the rules that don't hold; a null test doesn't hold."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items())))


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def _null_or(c: str, test: Column) -> Column:
    return F.col(c).isNull() | test


#: Fixed value: the form of a source type.
SOURCE_TYPE = "^[a-z][a-z0-9_]*$"


def _source_type(c: Column) -> Column:
    return c.rlike(SOURCE_TYPE) & (F.char_length(c) <= 32)


def fields_of(kind: str) -> dict[str, str]:
    """Key -> type of a kind's records."""
    return dict(f.strip().split(" ") for f in schemas.KINDS[kind][1].split(","))


#: Type of a key in a schema -> type of its JSON value.
VALUE_TYPES = {"string": "STRING", "boolean": "BOOLEAN", "int": "BIGINT", "array<string>": "ARRAY<STRING>"}


def once(value: Column) -> Column:
    """``value`` as a column of its own that is computed once a row; a plain one is copied by the optimizer to every filter and field that uses it."""
    return F.explode(F.array(value))


def value_types(value: Column | str) -> Column:
    """Key -> type of its JSON value, of a line that holds one object; null for any other line. The line is parsed once."""
    return F.transform_values(F.try_variant_get(F.try_parse_json(value), "$", "map<string,variant>"), lambda _, v: F.schema_of_variant(v))


def typed(types: Column, name: str, kind: str, nullable: bool) -> Column:
    """The key is there and its JSON value has the type of the schema; ``types``: of ``value_types``."""
    return types[name].isin(VALUE_TYPES[kind], *(["VOID"] if nullable else []))


def record_rules(kind: str, p: str = "record.") -> dict[str, Column]:
    """VAL-1: what the values of a kind's record must meet beside their types; ``p`` is the prefix of its fields."""
    c = lambda n: F.col(p + n)
    moment = lambda n: c(n).rlike(schemas.INSTANT) & F.try_to_timestamp(c(n), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNotNull()
    if kind == "posts":
        return {
            "unique_id": F.char_length(c("unique_id")).between(1, 256),
            "source": _filled(p + "source"),
            "source_type": _source_type(c("source_type")),
            "posted_at": moment("posted_at"),
            "urls": (F.size(c("urls")) >= 1) & F.forall(c("urls"), lambda u: u.rlike(WEB)),
            "unique_urls": F.size(F.array_distinct(c("urls"))) == F.size(c("urls")),
        }
    if kind == "rss_observations":
        return {
            "normalized_url": _filled(p + "normalized_url"),
            "feed_url": _filled(p + "feed_url"),
            "observed_at": moment("observed_at"),
            "status": _null_or(p + "status", c("status").between(0, 599)),
            "latest_entry_at": _null_or(p + "latest_entry_at", moment("latest_entry_at")),
        }
    if kind == "checkpoints":
        return {"source_type": _source_type(c("source_type")), "source_key": _filled(p + "source_key"), "cursor": _filled(p + "cursor"), "observed_at": moment("observed_at")}
    return {n: _filled(p + n) for n in (("did", "handle") if kind == "bluesky_follows" else ("account_id", "acct"))}


def checked_records(rows: DataFrame, kind: str) -> DataFrame:
    """VAL-1: ``rows (value, record)`` with ``errors``: not one JSON object, unknown or missing keys, wrong types, broken rules.

    A key's rule has the key's name; a wrong type and a missing key break it too. A line that has a key twice is no object.
    """
    fields, values = fields_of(kind), record_rules(kind)
    types, known = F.col("_types"), F.array(*map(F.lit, fields))
    keys = F.map_keys(types)
    rules = {"json": types.isNotNull(), "unknown_keys": F.size(F.array_except(keys, known)) == 0, "missing_keys": F.size(F.array_except(known, keys)) == 0}
    for name, type_ in fields.items():
        right = typed(types, name, type_, name in schemas.NULLABLE[kind])
        rules[name] = right & values.pop(name) if name in values else right
    return rows.select("*", once(value_types("value")).alias("_types")).select(*rows.columns, once(errors(rules | values)).alias("errors"))


def manifest_problems(manifests: DataFrame) -> DataFrame:
    """VAL-2: ``batch_id, problem``."""
    names = F.transform("files", lambda f: f["name"])
    rules = {
        "version": F.col("contract_version") == schemas.CONTRACT_VERSION,
        "batch_id": F.col("batch_id").rlike(BATCH_ID) & (F.col("batch_id") == F.col("dir_batch_id")),
        "created_at": contract_timestamp("created_at").isNotNull(),
        "repeated_names": F.size(F.array_distinct(names)) == F.size(names),
        "counts": F.forall("files", lambda f: f["record_count"] >= 0),
        "kinds": F.forall("files", lambda f: f["kind"].isin(*schemas.KINDS)),
        "names": F.forall(
            "files",
            lambda f: F.when(f["kind"] == "mastodon_follows", f["name"] == F.concat(F.lit("mastodon-follows-"), f["scope"], F.lit(".ndjson")))
            .otherwise(f["name"] == F.concat(F.replace(f["kind"], F.lit("_"), F.lit("-")), F.lit(".ndjson"))),
        ),
    }
    return manifests.select(F.col("dir_batch_id").alias("batch_id"), F.explode(errors(rules)).alias("problem"))


def batch_problems(files: DataFrame, present: DataFrame) -> DataFrame:
    """VAL-3, SET-3: ``batch_id, name, problem``: missing, undeclared, checksum, record count, a blank line and its number.

    ``present``: ``batch_id, name, sha256, lines, blank_line``.
    """
    there = present.withColumn("there", F.lit(True))
    both = files.select("batch_id", "name", "record_count", F.col("sha256").alias("want")).join(there, ["batch_id", "name"], "full")
    problem = (
        F.when(F.col("there").isNull(), "missing")
        .when(F.col("want").isNull(), "undeclared")
        .when(F.col("want") != F.col("sha256"), "checksum")
        .when(F.col("record_count") != F.col("lines"), "record_count")
        .when(F.col("blank_line").isNotNull(), F.concat(F.lit("blank_line "), F.col("blank_line").cast("string")))
    )
    return both.select("batch_id", "name", problem.alias("problem")).where("problem is not null")


def reject(batches: DataFrame, problems: DataFrame) -> DataFrame:
    """VAL-4: a batch fails as a whole, the others go on. The ids of bad batches go to all tasks, so that a batch isn't gathered in one."""
    return batches.join(F.broadcast(problems.select("batch_id").distinct()), "batch_id", "left_anti")


def quarantine(problems: DataFrame, now: Column) -> DataFrame:
    """SNK-7: ``batch_id, reason, failed_at``."""
    return problems.groupBy("batch_id").agg(F.array_join(F.array_sort(F.collect_set("problem")), "; ").alias("reason")).withColumn("failed_at", now)


#: VAL-6, VAL-7: constraints of a table; a function, as columns need a session.
TABLE_RULES = {
    "posts": lambda: {"unique_id": _filled("unique_id"), "source_type": _source_type(F.col("source_type"))},
    "post_urls": lambda: {"url": _filled("url"), "position": F.col("position") >= 0, "url_hash": F.char_length("url_hash") == 64},
    "health": lambda: {"normalized_url": _filled("normalized_url"), "consecutive_failures": F.col("consecutive_failures") >= 0},
    "ledger": lambda: {"batch_id": _filled("batch_id"), "record_count": F.col("record_count") >= 0},
    "checkpoints": lambda: {"source_key": _filled("source_key"), "cursor": _filled("cursor")},
}


def table_rules(table: str) -> dict[str, Column]:
    """VAL-6, VAL-7: constraints of a table."""
    return TABLE_RULES[table]()
