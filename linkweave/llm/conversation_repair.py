"""Cheapest repair of a conversation's structure by an integer-minimum DAG dynamic programme.

A repaired conversation's role initials read ``(s?(ua)+)?``. Each row is kept (K, cost 0), given the role user or assistant (R, 2)
or deleted (D, 3); rows of empty text may be inserted anywhere (I, 2); a truncated row that stays costs 1; blank and
duplicate rows have to go. Of the cheapest repairs the one whose audit, the edits' initials in order, is least in ASCII is taken.

Both wishes are one integer. Its high digits carry the cost; below, each row has a slot of fixed width with the letters of its
edits as digits, those of inserts before the row first, zeros after them; a last slot holds the inserts at the end. A slot's letters are
inserts and then exactly one K, R or D, so two slots that differ do so at a letter of both, and comparing integers compares
costs, then audits. A node of the DAG is a row and the state of the pattern before it; an edge adds its cost and digits to
the integer; the least integer at the end decides everything, and the audit is read off its digits.

After ``BLOCK`` rows the digits so far are replaced by their rank among the states' (different states have different
audits), so integers stay short and time is linear in a conversation's rows, however long it is.

``damage`` harms rows by a hash of their key, to have something to repair. Faults, edits and digests are of the rows after it.

Rows are in the order of turn, nulls first, then of their role and text before the damage (ties; repeated rows stay, and are
duplicates). Null roles and texts are one space, as are null conv_ids and turns in the hashed key. Null conv_ids are one conversation. A
role's initial is its first character, so an empty role has none and can't be kept. Very long texts are taken whole. A conversation is one row
of one task, since its digest is of one text. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import ship

#: Edits and their costs; the digits follow the letters' order in ASCII.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {v: k for k, v in DIGIT.items()}
DIGIT_BITS, SLOT_DIGITS = 3, 3
SLOT_BITS = DIGIT_BITS * SLOT_DIGITS
BLOCK = 64
RANK_BITS = 3
RANK_AT = SLOT_BITS * (BLOCK + 1)
COST_AT = RANK_AT + RANK_BITS
#: States of the pattern: nothing yet, after s, after u, after a. What an initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
INSERTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ILLEGAL_BUT = {("s", "u"), ("u", "a"), ("a", "u")}
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def digits(letters: str) -> int:
    """The letters as a slot: left to right, zeros at the end."""
    out = 0
    for i in range(SLOT_DIGITS):
        out = out << DIGIT_BITS | (DIGIT[letters[i]] if i < len(letters) else 0)
    return out


@lru_cache(maxsize=None)
def edges(initial: str, must_go: bool, truncated: bool) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, slot) of the edges over one row; of parallel ones the least is enough."""
    least: dict[tuple[int, int], tuple[int, int]] = {}
    for start in range(4):
        state, spent, letters = start, 0, ""
        for _ in range(SLOT_DIGITS):  # with no, one, two inserts before the row
            ends = [(state, DELETE, "D")]
            if not must_go:
                ends += [(to, KEEP + TRUNCATED * truncated, "K") for to in [NEXT.get((state, initial))] if to is not None]
                ends += [(to, REROLE + TRUNCATED * truncated, "R") for to in [NEXT.get((state, x)) for x in "ua"] if to is not None]
            for to, cost, letter in ends:
                edge = (spent + cost, digits(letters + letter))
                least[start, to] = min(edge, least.get((start, to), edge))
            state, spent, letters = INSERTED[state], spent + INSERT, letters + "I"
    return [(start, to, cost, slot) for (start, to), (cost, slot) in sorted(least.items())]


#: What follows the last row, so that the pattern is complete: (cost, slot) of each state.
ENDS = {START: (0, 0), ASSISTANT: (0, 0), USER: (INSERT, digits("I")), SYSTEM: (2 * INSERT, digits("II"))}


def letters_of(number: int) -> str:
    """The letters of the digits below the rank, zeros left out."""
    return "".join(LETTER[d] for i in range(RANK_AT - DIGIT_BITS, -1, -DIGIT_BITS) if (d := number >> i & ((1 << DIGIT_BITS) - 1)))


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """(cost, audit) of ``rows (initial, must_go, truncated)``."""
    value: list[int | None] = [0, None, None, None]
    finished: list[dict[int, tuple[int, int]]] = []  # of each block: rank -> (rank before, digits)
    low = (1 << RANK_AT) - 1
    for i, (initial, must_go, truncated) in enumerate(rows):
        shift = SLOT_BITS * (BLOCK - i % BLOCK)
        reached: list[int | None] = [None] * 4
        for start, to, cost, slot in edges(initial if initial in ("s", "u", "a") else "", must_go, truncated):
            if value[start] is not None:
                number = value[start] + (cost << COST_AT) + (slot << shift)
                if reached[to] is None or number < reached[to]:
                    reached[to] = number
        value = reached
        if i % BLOCK == BLOCK - 1:
            audits = sorted({v & ((1 << COST_AT) - 1) for v in value if v is not None})
            finished.append({rank: (a >> RANK_AT, a & low) for rank, a in enumerate(audits)})
            value = [None if v is None else (v >> COST_AT << COST_AT) + (audits.index(v & ((1 << COST_AT) - 1)) << RANK_AT) for v in value]
    best = min(v + (ENDS[s][0] << COST_AT) + ENDS[s][1] for s, v in enumerate(value) if v is not None)
    audit, rank = [letters_of(best & low)], best >> RANK_AT & ((1 << RANK_BITS) - 1)
    for block in reversed(finished):
        rank, own = block[rank]
        audit.append(letters_of(own))
    return best >> COST_AT, "".join(reversed(audit))


def apply_edits(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """``rows (role, text)`` after the edits; the pattern leaves one role for each R and I."""
    out: list[tuple[str, str]] = []
    left = iter(rows)
    for letter in audit:
        needed = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if letter == "I":
            out.append((needed, ""))
            continue
        role, text = next(left)
        if letter != "D":
            out.append((role if letter == "K" else needed, text))
    return out


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """Each row's first fault, or an empty string."""
    seen, out = set(), []
    for row in rows:
        text = row[1].rstrip(SPACES)
        out.append("blank" if not VISIBLE.search(text) else "duplicate" if row in seen else "truncated" if text[-1] not in ".!?" else "")
        seen.add(row)
    return out


def repaired(turns: list[int | None], rows: list[tuple[str, str]]) -> dict:
    """The counts, the cost, the audit and the repaired rows of one conversation."""
    found = faults(rows)
    numbers = {t for t in turns if t is not None}
    initials = [role[:1] for role, _ in rows]
    cost, audit = cheapest([(x, f in ("blank", "duplicate"), f == "truncated") for x, f in zip(initials, found, strict=True)])
    return {
        "gaps": min(max(numbers) - min(numbers) + 1 - len(numbers), (1 << 63) - 1) if numbers else 0,
        **{f: found.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(pair not in ILLEGAL_BUT for pair in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired": [{"role": role, "text": text} for role, text in apply_edits(rows, audit)],
    }


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies, order`` of the rows of ``conversations``; ``copies`` is 0 for a dropped row, 2 for a repeated one."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    role, text = word("role"), word("text")
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
        F.struct(F.col("turn").isNotNull(), "turn", role, text).alias("order"),
    )


def in_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, rows``: the rows of ``damage`` in order, repeated ones next to each other, dropped ones left out."""
    each = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("copies") > 0, F.struct("order", "turn", "role", "text", "copies")))).alias("rows"))
    one = lambda r: F.struct(r["turn"].alias("turn"), r["role"].alias("role"), r["text"].alias("text"))
    return each.select("conv_id", F.flatten(F.transform("rows", lambda r: F.array_repeat(one(r), r["copies"]))).alias("rows"))


REPAIRED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role: string, text: string>>"


def repair(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and the columns of ``REPAIRED`` from ``conv_id, rows``, a row for each conversation."""
    ship(conversations.sparkSession)
    row = pa.struct([("role", pa.string()), ("text", pa.string())])
    kinds = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), pa.int64()) | {"audit": pa.string(), "repaired": pa.list_(row)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [repaired([r["turn"] for r in rows], [(r["role"], r["text"]) for r in rows]) for rows in batch.column("rows").to_pylist()]
            columns = [pa.array([x[name] for x in found], kind) for name, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", *kinds])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return conversations.select("conv_id", "rows").mapInArrow(run, f"conv_id {kind}, {REPAIRED}")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return repair(in_conversations(damage(table))).select("*", F.sha2(lines, 256).alias("repaired_sha256")).drop("repaired")


def _edge_sql(state: str, value: str) -> str:
    """DuckDB: candidates for ``state`` over one row, from the values E, S, U, A (cost in 9 digits, then the audit).

    At most one insert before a row: two in a row could both be left out, or the s before them deleted for less.
    """
    add = lambda v, cost, letters: f"lpad(CAST(CAST(left({v}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({v}, 10) || '{letters}'"
    after = {"E": "U", "S": "U", "U": "A", "A": "U"}
    step = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
    out = []
    for start in "ESUA":
        for at, paid, letters in ((start, "0", ""), (after[start], "2", "I")):
            if at == state:
                out.append(add(f"{value}_{start}", f"{paid} + 3", f"{letters}D"))
            for (source, initial), to in step.items():
                if source == at and to == state:
                    out.append(f"CASE WHEN NOT gone AND initial = '{initial}' THEN {add(f'{value}_{start}', f'{paid} + short', f'{letters}K')} END")
                    if initial != "s":
                        out.append(f"CASE WHEN NOT gone THEN {add(f'{value}_{start}', f'{paid} + 2 + short', f'{letters}R')} END")
    return f"least({', '.join(out)})"


ORACLE = rf"""
WITH RECURSIVE poly AS (
  SELECT n, 0 AS i, CAST(n AS BIGINT) AS x FROM range(256) r(n)
  UNION ALL SELECT n, i + 1, xor(x >> 1, 3988292384 * (x & 1)) FROM poly WHERE i < 8
), crc AS (
  SELECT list(x ORDER BY n) AS t FROM poly WHERE i = 8
), k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_transform(str_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) % 20 AS kind
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i
  FROM k, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), flagged AS (
  SELECT *, left(role, 1) AS initial, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    left(lead(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS following
  FROM damaged
), rows AS (
  SELECT *, bare = '' AS is_blank, bare <> '' AND again AS is_again, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS is_short,
    bare = '' OR again AS gone, CAST(bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS INT) AS short
  FROM flagged
), conv AS (
  SELECT DISTINCT conv_id FROM conversations
), dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS v_E, CAST(NULL AS VARCHAR) AS v_S, CAST(NULL AS VARCHAR) AS v_U, CAST(NULL AS VARCHAR) AS v_A FROM conv
  UNION ALL
  SELECT r.conv_id, r.i, {_edge_sql("E", "v")}, {_edge_sql("S", "v")}, {_edge_sql("U", "v")}, {_edge_sql("A", "v")}
  FROM dp JOIN rows r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1
), ended AS (
  SELECT conv_id, i, least(v_E, v_A, lpad(CAST(CAST(left(v_U, 9) AS INT) + 2 AS VARCHAR), 9, '0') || substr(v_U, 10) || 'I') AS best
  FROM dp QUALIFY i = max(i) OVER (PARTITION BY conv_id)
), audits AS (
  SELECT conv_id, CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM ended
), letters AS (
  SELECT conv_id, pos, audit[pos] AS letter, pos - length(regexp_replace(audit[1:pos], '[^I]', '', 'g')) AS i,
    length(regexp_replace(audit[1:pos], 'D', '', 'g')) AS nth
  FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS pos FROM audits)
), outs AS (
  SELECT l.conv_id, l.nth, l.letter, r.role, CASE WHEN l.letter = 'I' THEN '' ELSE r.text END AS text,
    max(CASE WHEN l.nth = 1 AND l.letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS system
  FROM letters l LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i WHERE l.letter <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY nth) AS lines
  FROM outs GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE is_blank) AS blank, count(*) FILTER (WHERE is_again) AS duplicate,
    count(*) FILTER (WHERE is_short) AS truncated, count(*) FILTER (WHERE following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  cost, audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM conv c JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
