import random
import re
import time

from linkweave.llm import licenses as lic

PLAIN = ["the cat sat on the mat", "a general view of the public in this version", "nothing here"]


def test_variants_and_near_misses():
    model = lic.train(PLAIN * 20)
    for family, notices in lic.NOTICES.items():
        for notice in notices:
            found = model.classify("Copyright 2021 A. Body. " + notice.upper())
            assert found and found[0] == family, (family, notice, found)
    for paragraph in [*lic.NEAR_MISSES, *PLAIN, "", "w " * 20_000]:
        assert model.classify(paragraph) is None


def test_wrapped_notices_and_two_families_in_a_line():
    model = lic.train(PLAIN * 20)
    gpl = ["# This program is free software: you can redistribute it and/or modify", "# it under the terms of the GNU General Public License as published by", "# the Free Software Foundation, either version 3 of the License, or", "# (at your option) any later version."]
    assert [m[:2] for m in model.matches(["import os", "", *gpl, "", "nothing here"])] == [(2, "gpl-3.0")]
    for family, notices in lic.NOTICES.items():
        for notice in notices:
            words = notice.split()
            lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
            assert [m[1] for m in model.matches(lines)] == [family], (lines, model.matches(lines))
    both = model.matches(["Released under the MIT License. Licensed under the Apache License, Version 2.0."])
    assert sorted(m[1] for m in both) == ["apache-2.0", "mit"]


def plain_matches(model, lines):
    """``matches`` with every group compared with everything taken so far."""
    words = [lic.words_of(line) for line in lines]
    taken = [(i, i, m) for i, w in enumerate(words) for m in model.all_confirmed(w)]
    pairs = [set(zip(w, w[1:])) for w in words]
    over = [{(a[-1], b[0])} if a and b else set() for a, b in zip(words, words[1:])]
    hit = [bool((pairs[i] | (over[i - 1] if i else set()) | (over[i] if i < len(over) else set())) & model.known) for i in range(len(lines))]
    groups = []
    for i in range(len(lines)):
        for j in range(i + 1, len(lines)):
            between = lines[i + 1 : j + 1]
            if not (hit[i] and hit[j]) or not all(x.strip() for x in between) or sum(map(len, words[i:j])) > lic.MOST_WORDS:
                continue
            found = model.all_confirmed([w for x in words[i : j + 1] for w in x])
            if found:
                groups += [(i, j, m) for m in found]
                taken = [t for t in taken if t[0] < i or t[0] > j or t[2][0] in {m[0] for m in found} or t[2][2] >= max(m[2] for m in found)]
    for i, j, m in sorted(groups, key=lambda g: (-g[2][2], g[1] - g[0], -g[2][1], g[0])):
        common = [(len({*range(i, j + 1)} & {*range(x, y + 1)}), x > j + 1 or y < i - 1, n) for x, y, n in taken]
        if all(far or (n[0] != m[0] and k <= 1) for k, far, n in common):
            rest = [w for x in words[i : j + 1] for w in x]
            for k, _, n in common:
                rest = lic.without(rest, n[3]) if k == 1 else rest
            if m[0] in {n[0] for n in model.all_confirmed(rest)}:
                taken.append((i, j, m))
    return sorted((i, *m[:3]) for i, _, m in taken)


def test_matches_equal_a_plain_version():
    model, rng = lic.train(PLAIN * 20), random.Random(3)
    notices = [n for own in lic.NOTICES.values() for n in own]
    for _ in range(40):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice([*notices, *lic.NEAR_MISSES, *PLAIN]).split()
            if rng.random() < 0.3:
                words += rng.choice(notices).split()
            step = rng.choice([4, 9, 100])
            lines += [" ".join(words[i : i + step]) for i in range(0, len(words), step)]
            lines += rng.choice([[], [], [""], ["----"], ["***", "  "]])
        assert model.matches(lines) == plain_matches(model, lines), lines


def test_time_is_linear_in_the_notices_of_a_text():
    model = lic.train(PLAIN * 20)
    notice = lic.NOTICES["gpl-3.0"][0].split()
    block = [" ".join(notice[i : i + 8]) for i in range(0, len(notice), 8)] + [""]
    seconds = []
    for n in (60, 480):
        began = time.process_time()
        assert len(model.matches(block * n)) == n
        seconds.append(time.process_time() - began)
    assert seconds[1] < 20 * seconds[0] + 0.5
    assert model.matches(["----"] * 50_000 + block + ["----"] * 50_000)[0][0] == 50_000


def test_scan_of_odd_tables(spark):
    model = lic.train(PLAIN * 20)
    docs = [(1, None, "x"), (2, "", "x"), (None, "Released under the MIT License.", "x"), (3, "a\n\nLicensed under CC BY-NC 4.0.\nb\nLicensed under CC BY-SA 4.0.", "x"), (3, "a", "x"), (3, "a", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, matches string")
    got = sorted((r.doc_id or 0, r.n_paragraphs, [(m.paragraph, m.family) for m in r.matches]) for r in lic.scan(frame, model).collect())
    assert got == [(0, 1, [(0, "mit")]), (1, 0, []), (2, 0, []), (3, 1, []), (3, 1, []), (3, 4, [(2, "cc-by-nc"), (4, "cc-by-sa")])]
    assert lic.scan(frame.limit(0), model).count() == 0


def test_query_finds_exactly_the_documents_with_notices(spark):
    sf = "/root/testdata/sf0.01"
    lines = {"apache-2.0": "Licensed under the Apache License", "mit": "Released under the MIT License", "gpl-3.0": "GNU General Public License, version 3", "cc-by-nc": "Licensed under CC BY-NC"}
    rows = lic.op3_licenses(spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = sorted(f for f, line in lines.items() if re.search(f"(?m)^.*{re.escape(line)}", texts[r.doc_id]))
        assert r.families == ",".join(want)
