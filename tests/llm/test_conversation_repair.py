import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

from pyspark.sql import functions as F

from linkweave.llm import conversation_repair as cr

PATTERN = re.compile(r"(s?(ua)+)?")


def exhaustive(rows):
    """(cost, audit, roles) of the best of all edits with at most two inserts in a place."""
    best = None
    places = [["", "u", "a", "uu", "ua", "au", "aa"]] * (len(rows) + 1)
    own = [["D"] + ([] if must_go else ["K", "Ru", "Ra"]) for _, must_go, _ in rows]
    for choice in product(*own):
        for inserts in product(*places):
            initials, audit, cost = "", "", 0
            for i, ins in enumerate(inserts):
                initials += ins
                audit += "I" * len(ins)
                cost += 2 * len(ins)
                if i < len(rows):
                    initial, _, truncated = rows[i]
                    e = choice[i]
                    audit += e[0]
                    cost += {"D": 3, "K": 0, "R": 2}[e[0]] + (truncated and e != "D")
                    initials += {"D": "", "K": initial}.get(e, e[1:])
                    if e == "K" and len(initial) != 1:
                        cost += 1000
            if PATTERN.fullmatch(initials) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def by_suffixes(rows):
    """The same from the end on, with tuples of cost and string."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    end = {"": (0, ""), "a": (0, ""), "u": (2, "I"), "s": (4, "II")}
    for initial, must_go, truncated in reversed(rows):
        def own(state):
            found = [(end[state][0] + 3, "D" + end[state][1])]
            if not must_go:
                for x, cost, letter in ((initial, 0, "K"), ("u", 2, "R"), ("a", 2, "R")):
                    if x in step[state]:
                        to = step[state][x]
                        found.append((end[to][0] + cost + truncated, letter + end[to][1]))
            return min(found)
        def inserted(state, left):
            found = [own(state)]
            if left:
                for x in "ua":
                    if x in step[state]:
                        cost, audit = inserted(step[state][x], left - 1)
                        found.append((cost + 2, "I" + audit))
            return min(found)
        end = {state: inserted(state, 2) for state in step}
    return end[""]


def test_cheapest_equals_exhaustive_search():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice(["s", "u", "a", "x", ""]), rng.random() < 0.25, rng.random() < 0.3) for _ in range(rng.randrange(0, 4))]
        rows = [(i, m, t and not m) for i, m, t in rows]
        assert cr.cheapest(rows) == exhaustive(rows) == by_suffixes(rows), rows


def test_long_conversations_over_many_blocks():
    rng = random.Random(6)
    for n in (cr.BLOCK - 1, cr.BLOCK, cr.BLOCK + 1, 5 * cr.BLOCK, 700):
        for _ in range(5):
            rows = [(rng.choice("suaax"), rng.random() < 0.2, False) for _ in range(n)]
            assert cr.cheapest(rows) == by_suffixes(rows)
    rows = [("u" if i % 2 == 0 else "a", False, i % 7 == 0) for i in range(100_000)]
    assert cr.cheapest(rows) == (sum(t for _, _, t in rows), "K" * len(rows))


def expected(table):
    """The query's rows for ``table (conv_id, turn, role, text)``, one conversation after the other."""
    talks = {}
    for conv, turn, role, text in table:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        new = ("user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        talks.setdefault(conv, []).extend([((turn is not None, turn or 0, role, text), turn, *new)] * {0: 0, 3: 2}.get(kind, 1))
    out = {}
    for conv, rows in talks.items():
        rows = sorted(rows, key=lambda r: r[0])
        seen, faults = set(), []
        for _, _, role, text in rows:
            bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {r[1] for r in rows if r[1] is not None}
        cost, audit = by_suffixes([(r[2][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults, strict=True)])
        lines = cr.apply_edits([r[2:] for r in rows], audit)
        assert PATTERN.fullmatch("".join(role[0] for role, _ in lines))
        pairs = zip(rows, rows[1:])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum((a[2][:1], b[2][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{role}:{text}" for role, text in lines).encode()).hexdigest(),
        )
    return out


def test_odd_conversations(spark, tmp_path):
    long = "word " * 50_000
    table = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, None, None), (None, 1, "assistant", long), (None, None, "user", "so?"), (2, 5, "", "x."), (2, -3, "User", "é"), (3, 1, "system", "S."), (4, 0, "umbrella", "a.\x0b")]
    table += [(5 + i // 6, i % 6 - (i % 5 == 0), ("system", "user", "assistant")[i * i % 3], ("Yes.", "no", " \t", "What? ", None)[i % 5]) for i in range(240)]
    table += [(77, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(1000)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(3)
    df.select("*", *(F.lit(1).alias(n) for n in ("order", "copies", "rows", "x.y"))).write.parquet(str(tmp_path / "conversations.parquet"))
    rows = cr.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in rows} == expected(table) and len(rows) == len({t[0] for t in table})
    empty = cr.repair(cr.in_conversations(cr.damage(df.limit(0))))
    assert empty.count() == 0
