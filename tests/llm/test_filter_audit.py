import re
from itertools import permutations

import pytest

from linkweave.llm import filter_audit as fa

WORDS = "one two three Four five six seven".split()
DOCS = [
    (1, " ".join(f"w{i}" for i in range(250)), "s"),
    (2, " ".join(f"w{i}" for i in range(250)), "s"),
    (2, " ".join(f"w{i}" for i in range(250)), "t"),
    (3, "a " * 400, None),
    (4, "a " * 400, ""),
    (5, None, "s"),
    (6, "", "s"),
    (7, "SHOUT & run", "t"),
    (8, "LOUD WORDS " * 150, "t"),
    (9, " ".join(f"W{i}|" for i in range(30_000)), "u"),
    (None, "a " * 400, "u"),
    (None, None, None),
    (10, " \t\r\n\x0b\x0c", "s"),
    (11, "x" * 300 + "A" * 6, "s"),
    (12, "x" * 300 + "A" * 7, "s"),
]
LABELS = [(1, 1, 0), (2, None, 1), (2, 1, None), (3, 0, 1), (4, 1, 1), (None, 1, 1), (7, None, None), (8, 1, 0), (99, 1, 1)]


def brute_force(docs, labels):
    """Counts of each (part, order, step) by walking every document through every order."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, removed_by = {}, {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for i, text, source in docs:
        text, part = text or "", source or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and i > first[text] else set()
        for order in orders:
            gone = False
            for step, letter in enumerate(order, 1):
                row = out.setdefault((part, order, step), dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), 0))
                row["unique_fails"] += fails == {letter}
                if letter in fails:
                    row["redundant" if gone else "removed"] += 1
                    if not gone:
                        row["good_lost"] += i in good
                        row["toxic_lost"] += i in toxic
                        removed_by[part, letter] = removed_by.get((part, letter), 0) + 1
                    gone = True
                row["kept"] += not gone
    for (part, order, step), row in out.items():
        row["shapley"] = removed_by.get((part, order[step - 1]), 0)
    return out


def tables(spark, docs=DOCS, labels=LABELS):
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("common", [10_000, 2])
def test_audit_equals_a_walk_through_every_order(spark, monkeypatch, common):
    monkeypatch.setattr(fa, "HOT_ROWS", common)  # with 2 every repeated text goes the way of common ones
    docs, labels = tables(spark)
    got = {(r.part, r.filter_order, r.step): {k: v for k, v in r.asDict().items() if k not in ("part", "filter_order", "step")} for r in fa.audit(fa.masks(docs.repartition(3), labels)).collect()}
    assert got == brute_force(DOCS, LABELS)


def test_odd_tables(spark):
    from pyspark.sql import functions as F

    docs, labels = tables(spark)
    extra = docs.select("*", *(F.lit(1).alias(n) for n in ("mask", "part", "first", "KEY", "n", "g", "t", "words", "digest", "text_", "salt", "label", "x.y")))
    rows = fa.masks(extra, labels).collect()
    assert len(rows) == len(DOCS) and all(r["first"] == 1 and r["x.y"] == 1 and r["KEY"] == 1 for r in rows)
    assert fa.audit(fa.masks(docs.limit(0), labels)).count() == 0
    assert fa.audit(fa.masks(docs, labels.limit(0))).where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_fields_hold_large_counts():
    n, integers = 1 << 56, fa.packed()
    counts = fa.unpacked(n * integers[0] + n * integers[31])
    assert set(counts["kept"].tolist()) == {n}
    assert counts["removed"].tolist() == [n, 0, 0, 0, 0] * 120
    assert counts["shapley"].tolist() == [24 * n] * 600
