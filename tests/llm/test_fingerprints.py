import hashlib

import numpy as np

from linkweave.llm import fingerprints as fp

DOCS = [(3, "b"), (9, "one two three four five six seven eight nine ten"), (7, None), (7, "x y"), (None, "last"), (1, "É" * 5), (2, ""), (8, "w " * 20_000), (9, "one two three four five six seven eight nine ten")]


def expected(docs):
    docs = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is None, -(d[0] or 0), d[1]))
    out = []
    for k, (i, t) in enumerate(docs):
        f = docs[(k + 1) % len(docs)][1]
        out.append((i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + f[: len(t) // 2]).encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=str)


def test_edits_follow_descending_ids_over_many_ranges(spark):
    docs = DOCS + [(100 + i, f"text {i} " * (i % 7)) for i in range(50)]
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in fp.edited_likeness(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()]
    assert order(got) == order(expected(docs))


def test_one_row_follows_itself_and_empty_tables(spark):
    one = spark.createDataFrame([(4, "abcd")], "doc_id long, text string")
    row = fp.edited_likeness(one).collect()[0]
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0
    assert fp.edited_likeness(one.limit(0)).count() == 0


def test_lexicon_counts_documents_exactly(spark):
    texts = [" ".join(["common", f"rare{i}", f"pair{i // 2}", f"mid{i % 40}"]) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, term string").repartition(7)
    known = set(fp.lexicon(docs).tolist())
    import pyarrow as pa

    hash_of = lambda w: fp._terms(pa.array([w]))[0].tolist()[0]
    assert known == {hash_of(f"mid{i}") for i in range(40)} | {hash_of(f"pair{i}") for i in range(200)}
    prints = fp.fingerprints(docs, name="term").collect()
    assert len(prints) == 400 and all(r.term != "x" for r in prints)


def test_query_separates_edits_from_strangers(spark, small_dir):
    rows = fp.op2_fingerprints(spark, small_dir).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    assert order((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == order(expected(docs))
    by_text = {}
    text = dict(docs)
    for r in rows:
        assert by_text.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    long = [r for r in rows if r.n_chars > 300]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95


def hashes(n, seed=0):
    return np.sort(np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64))


def test_likeness_of_near_copies():
    terms = hashes(300)
    a, b = fp.fingerprint(terms, terms), fp.fingerprint(terms[3:], terms)
    assert fp.likeness(a, a) == 1.0 and 0.85 < fp.likeness(a, b) < 1
    assert fp.likeness(fp.EMPTY, a) == 0.0 and fp.likeness(fp.EMPTY, fp.EMPTY) == 1.0


def test_terms_outside_of_the_band_never_count():
    """Whatever the number of band terms: one term less is a small step, and other terms are none."""
    other = hashes(100, 1)
    for n in range(2, 40):
        band = hashes(n, n)
        whole, less = (fp.fingerprint(np.sort(np.concatenate([t, other])), band) for t in (band, band[1:]))
        assert whole == fp.fingerprint(band, band)
        mean = np.mean([fp.likeness(fp.fingerprint(hashes(n, s), hashes(n, s)), fp.fingerprint(hashes(n, s)[1:], hashes(n, s))) for s in range(30)])
        assert mean > 0.6 * (n - 1) / n - 0.1, (n, mean)
    outside = fp.fingerprint(other, hashes(9))
    assert outside.startswith(fp.OUTSIDE) and fp.likeness(outside, outside) == 1.0
    assert fp.likeness(outside, fp.fingerprint(other[1:], hashes(9))) == 0.0


def brute_force(terms, known):
    """The fingerprint from sets in plain Python: (level, band terms, subset members by level and subset)."""
    known = set(known.tolist())
    band = sorted(t for t in terms.tolist() if t in known)
    lowest = len(band).bit_length() - 1
    drawn = lambda t, k: int(fp.mix(np.array([t], np.uint64) ^ fp.SEEDS[k])[0])
    return lowest, band, [[tuple(t for t in band if drawn(t, k) % (1 << (lowest + level)) == 0) for k in range(fp.SUBSETS)] for level in range(fp.LEVELS)]


def test_fingerprints_equal_brute_force_sets(monkeypatch):
    """Equal hashes where and only where a brute-force lexicon subset holds the same terms; the likeness counts those."""
    rng = np.random.default_rng(5)
    known = hashes(400)
    texts = [np.sort(rng.choice(known, n, replace=False)) for n in (1, 3, 8, 60, 200)]
    texts += [np.sort(np.concatenate([t[: -max(1, len(t) // 10)], hashes(5, 9)])) for t in texts[1:]]
    for held in (1 << 20, 7):
        monkeypatch.setattr(fp, "HELD_HASHES", held)
        prints = [fp.fingerprint(t, known) for t in texts]
        sets = [brute_force(t, known) for t in texts]
        for a, (low, band, subsets) in zip(prints, sets, strict=True):
            assert int(a[:2]) == low and len(a) == 18 + 8 * fp.LEVELS * fp.SUBSETS
            for b, (low_b, band_b, subsets_b) in zip(prints, sets, strict=True):
                assert (a[2:18] == b[2:18]) == (band == band_b)
                same = seen = 0
                for level in range(max(low, low_b), min(low, low_b) + fp.LEVELS):
                    for x, y in zip(subsets[level - low], subsets_b[level - low_b], strict=True):
                        same, seen = same + (x == y and bool(x)), seen + bool(x or y)
                assert fp.likeness(a, b) == (1.0 if a == b else same / seen if seen else 0.0)


def test_query_columns_follow_from_the_fingerprints(spark, small_dir):
    """Every row's fingerprints and likenesses again, from the texts and the lexicon, one document at a time."""
    import pyarrow as pa

    table = spark.read.parquet(f"{small_dir}/documents.parquet")
    known = fp.lexicon(table)
    docs = sorted(((r.doc_id, r.text or "") for r in table.collect()), reverse=True)
    of = lambda t: fp.fingerprint(fp._terms(pa.array([t]))[0], known)
    want = {}
    for k, (i, t) in enumerate(docs):
        f = docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 2] + f[: len(t) // 2]
        want[i] = (of(t), of(edited), fp.likeness(of(t), of(edited)), fp.likeness(of(t), of(f)))
    got = {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fp.op2_fingerprints(spark, small_dir).collect()}
    assert got == want


def test_many_null_ids_are_several_ranges(spark):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(100)] + [(1, "first")], "doc_id long, text string")
    ranged = fp.in_overlapping_ranges(docs, 4)
    parts = ranged.where("not copy and doc_id is null").groupBy("range").count().count()
    assert parts > 8 and fp.edited_likeness(docs).count() == 101
