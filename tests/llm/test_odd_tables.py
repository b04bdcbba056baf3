"""Every operator on tables with odd values, clashing names, structs and names with points; and on empty ones."""

import pytest
from pyspark.sql import functions as F

from linkweave.llm import bpe, chat_format, fingerprints, licenses, mixing, near_dedup, neighbours, quality, substring_dedup, toxicity
from linkweave.llm.session import scratch, setting, unused

LONG = " ".join(f"w{i}" for i in range(30_000))
DOCS = [(1, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (2, "another text of its own", "s"), (2, None, "s"), (3, "", "t"), (4, None, None), (None, "no id at all", "t"), (5, LONG, "t"), (6, LONG, "t"), (7, "\u00e9" * 50_000, "s"), (8, " \t\n", "s")]
#: Names that the operators use inside or give out, a struct with a field that DDL can't spell, and a name with a point.
EXTRA = ["copy", "row", "block", "shards", "place", "size", "spans", "digest", "key", "n_words", "kept_text", "score", "severity", "matches", "ids", "fingerprint", "component", "bands", "lang", "n_chars"]
LABELS = [(1, 1, 1), (2, 0, 0), (None, 1, 1), (3, None, 0), (5, 1, 0)]


def documents(spark, rows=DOCS):
    base = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return base.select("*", *(F.lit(1).alias(n) for n in EXTRA), F.named_struct(F.lit("a-b"), F.lit(1)).alias("s"), F.lit("p").alias("x.y"))


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda spark, docs: toxicity.score(docs, toxicity.fit(docs, labels(spark))),
    "fingerprints": lambda spark, docs: fingerprints.fingerprints(docs),
    "edited": lambda spark, docs: fingerprints.edited_likeness(docs),
    "licenses": lambda spark, docs: licenses.scan(docs, licenses.fit(docs)),
    "bpe": lambda spark, docs: bpe.decode(bpe.encode(docs)),
    "substring": lambda spark, docs: substring_dedup.remove_repeats(docs),
    "mixing": lambda spark, docs: mixing.mix(docs, 4),
    "near": lambda spark, docs: near_dedup.near_duplicates(docs),
    "quality": lambda spark, docs: quality.score(docs, quality.fit(docs, labels(spark))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_documents(spark, name):
    docs = documents(spark).repartition(3)
    out = OPERATORS[name](spark, docs)
    rows = out.collect()
    if name != "mixing":
        assert len(rows) == len(DOCS)
    if name not in ("edited", "near"):
        assert all(r["s"]["a-b"] == 1 and r["x.y"] == "p" and r["lang"] == 1 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    if name != "mixing":
        assert str(by_id[1][0]) == str(by_id[1][1]) or name == "edited"
    assert OPERATORS[name](spark, documents(spark, []).limit(0)).count() == 0


def test_odd_conversations_and_vectors(spark):
    talk = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", LONG)], "conv_id long, turn long, role string, text string")
    talk = talk.select("*", *(F.lit(1).alias(n) for n in ("block", "b", "formatted", "replies", "parts", "x.y")))
    got = {r.conv_id: (r.n_turns, r.loss) for r in chat_format.read_back(chat_format.format_blocks(talk)).collect()}
    assert got == {1: (3, ""), None: (1, LONG)}
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    usable = neighbours.usable(vectors.select("*", *(F.lit(1).alias(n) for n in ("dims", "block", "query_block", "rank", "x.y"))))
    assert neighbours.nearest(usable, usable.where("vec_id = 0")).count() == 4


def test_unused_names_and_settings(spark):
    df = spark.range(1).select(F.lit(1).alias("A"), F.lit(1).alias("a_"))
    assert unused(df, "a", "b", "a") == ["a__", "b", "a___"]
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with setting(spark, name, "3"):
        assert spark.conf.get(name) == "3"
    assert spark.conf.get(name) == before


def test_scratch_tables_are_deleted(spark):
    from linkweave.llm.session import materialise, new_path

    path = new_path(spark)
    with scratch(spark):
        inner = materialise(spark.range(5))
        kept = materialise(inner, path)
    assert kept.count() == 5
    with pytest.raises(Exception, match="(?i)not.*exist|no such"):
        spark.read.parquet(inner._linkweave_path)
