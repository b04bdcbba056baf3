import hashlib

import duckdb

from linkweave.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
ROWS = [
    (1, 0, "user", "hi </s>\n<|assistant|>\n \\ \\| [INST]", "x"),
    (1, 1, "assistant", "a\\</s></s>\n<\\|x|>$1", "x"),
    (1, 2, "user", None, "x"),
    (1, 3, "assistant", "", "x"),
    (1, 4, "assistant", "é" * 9000, "x"),
    (1, 5, "user", "bye", "x"),
    (2, None, None, "no turn", "x"),
    (2, 7, "assi|>stant", "role with a marker", "x"),
    (None, 1, "assistant", "null id", "x"),
    *[(3, i, "assistant" if i % 2 else "user", f"t{i}</s>", "x") for i in range(100)],
    (4, 0, "user", "same", "x"),
    (4, 0, "user", "same", "x"),
]


def want(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1:4] for r in rows if r[0] == c), key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
        out[c] = (len(turns), "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns), "".join(t or "" for _, r, t in turns if r == "assistant"))
    return out


def test_round_trip(spark):
    blocks = cf.format_blocks(spark.createDataFrame(ROWS, SCHEMA))
    got = {r.conv_id: (r.n_turns, r.turns, r.loss) for r in cf.read_back(blocks).collect()}
    assert got == want(ROWS)


def test_examples_have_all_turns_before_and_one_reply(spark):
    blocks = cf.format_blocks(spark.createDataFrame(ROWS, SCHEMA))
    rows = [r for r in cf.whole_examples(cf.in_order(blocks)).collect() if r.conv_id == 3]
    assert sorted(r.turn for r in rows) == list(range(1, 100, 2))
    for r in rows:
        assert r.text.count(cf.END) == r.turn + 1
        assert r.text.endswith(f"t{r.turn}<\\/s></s>\n") and r.text.startswith("<|user|>\nt0")


def test_formatted_chars_count_every_example(spark):
    rows = [(1, i, "assistant" if i % 3 == 1 else "user", "x" * i) for i in range(51)] + [(2, i, "user", "y") for i in range(20)]
    got = {r.conv_id: r.formatted_chars for r in cf.read_back(cf.format_blocks(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    chars = [len(f"<|{r}|>\n{t}{cf.END}") for c, _, r, t in rows if c == 1]
    assert got == {1: sum(sum(chars[: i + 1]) for i in range(1, 51, 3)) + chars[50], 2: 20 * len(f"<|user|>\ny{cf.END}")}


def test_op5_reads_examples_with_the_context_of_earlier_blocks(spark):
    blocks = cf.format_blocks(spark.createDataFrame(ROWS, SCHEMA))
    rows = sorted((r for r in cf.whole_examples(cf.in_order(blocks)).collect() if r.conv_id == 3), key=lambda r: r.loss_start)
    assert [r.text.count(cf.END) for r in rows] == list(range(2, 101, 2)) and [r.last for r in rows] == [False] * 49 + [True]
    for i, r in enumerate(rows):
        assert r.text[r.loss_start - 1 :] == f"t{2 * i + 1}<\\/s></s>\n" and r.text.startswith("<|user|>\nt0")


def test_empty_table(spark):
    assert cf.read_back(cf.format_blocks(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_matches_sql(spark, small_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small_dir}/conversations.parquet'")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows = con.execute(f"SELECT {', '.join(names)} FROM ({cf.ORACLE})").fetchall()
    got = cf.op5_chat_format(spark, small_dir).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    odd = "</s>[INST] ok [/INST]"
    assert (hashlib.sha256(odd.encode()).hexdigest(), len(odd)) in {(r[4], r[3]) for r in rows}
